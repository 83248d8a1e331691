"""The stages of the corpus pipeline, alone and in a row, on tables with odd rows."""

import random
import re

import corpus_pipeline
from shopledger.llm import jaccard_join, line_dedup, packing, quality_rules
from shopledger.llm.common import load_tokenizer, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], SCHEMA).repartition(3)


def found(df):
    assert df.columns == COLUMNS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def labels_of(spark, tmp_path, good, docs=None):
    spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    if docs is not None:
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_quality_stage_judges_each_row_by_its_own_text(spark, tmp_path):
    good = {k: prose(k) for k in range(6)}
    rows = [(0, good[0]), (1, good[1]), (None, good[2]), (None, "too short"), (7, good[3]), (7, "la " * 50), (8, None), (9, ""), (1, good[1])]
    stage = corpus_pipeline.quality_stage(spark, table(spark, rows), labels_of(spark, tmp_path, [0, 1]))
    assert found(stage) == sorted([(0, good[0]), (1, good[1]), (1, good[1]), (None, good[2]), (7, good[3])], key=repr)
    scored = quality_rules.score_documents(table(spark, rows), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert scored.filter("kept").count() == 5


def test_near_duplicate_stage_keeps_rows_with_null_and_repeated_ids(spark):
    a, b, c, d = (prose(k) for k in range(20, 24))
    near = " ".join([*c.split()[:-1], "changed"])
    rows = [(None, a), (None, b), (7, c), (7, d), (5, near), (None, a), (7, d), (8, ""), (9, None), (9, None), (3, "two words"), (4, "two words"), (None, d)]
    got = found(corpus_pipeline.near_duplicate_stage(spark, table(spark, rows), ""))
    assert got == sorted([(None, a), (None, b), (5, near), (7, d), (8, ""), (9, None), (3, "two words")], key=repr)


def test_one_of_each_group_stays_whatever_the_order(spark):
    base = prose(1, 80).split()
    rows = [(100 - k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(0, 40, 10)] + [(50, prose(2))]
    got = jaccard_join.without_near_duplicates(table(spark, rows), words=5, percent=60)
    assert [i for i, _ in found(got)] == [50, 70]


def test_line_stage_takes_differing_texts_of_one_id_apart(spark):
    rows = [(1, "a b\nfooter"), (7, "c d\nfooter\ne f"), (7, "g h"), (None, "footer"), (7, "c d\nfooter\ne f")]
    assert found(corpus_pipeline.line_stage(spark, table(spark, rows), "")) == sorted([(1, "a b\nfooter"), (7, "c d\ne f"), (7, "g h"), (None, "footer"), (7, "c d\ne f")], key=repr)


def test_longest_runs_are_found_by_doubling(spark):
    run = [f"line {k}" for k in range(13)]
    rows = [(1, "\n".join(["top", *run, "end"])), (2, "\n".join(["\n".join(run[:11]), "", "other"])), (3, "\n".join(["x", *run[2:9], "y", *run[4:8]]))]
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in line_dedup.repeated_runs(table(spark, rows), 3).collect()}
    assert runs == {2: [(0, 11)], 3: [(1, 8), (9, 13)]}


def test_substring_and_packing_stages(spark):
    passage = prose(5, 25)
    rows = [(1, f"{prose(6)} {passage}"), (2, f"{prose(7, 10)} {passage} tail"), (3, None), (None, passage)]
    cut = corpus_pipeline.substring_stage(spark, table(spark, rows), "")
    texts = dict(found(cut.filter("doc_id is not null")))
    assert texts[1] == rows[0][1] and texts[2].split() == [*prose(7, 10).split(), "tail"] and texts[3] is None
    tokens = load_tokenizer(tokenizer_path(packing.VOCABULARY))
    packed = corpus_pipeline.packing_stage(spark, cut, "").collect()
    assert sorted((r.doc_id, r.length) for r in packed if r.doc_id) == [(i, len(tokens.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in sorted(texts.items())]


def test_stages_take_an_empty_table(spark, tmp_path):
    sf = labels_of(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), sf).count() == 0


def test_run_passes_each_stage_on(spark, tmp_path):
    passage, footer = prose(30, 60), "all rights reserved by the makers of this page"
    good = {k: f"{prose(100 + k, 50)}\n{footer}" for k in range(1, 9)}
    copy = {11: good[1], 12: good[2].replace(" ", "  ", 1), 13: f"{good[3].splitlines()[0]} more words"}
    shared = {k: f"{prose(200 + k, 50)} {passage} {prose(300 + k, 50)}" for k in (21, 22)}
    junk = {31: "la " * 60, 32: "short", 33: None}
    docs = good | copy | shared | junk
    sf = labels_of(spark, tmp_path, [*good, 21, 22], table(spark, docs.items()))
    packed = corpus_pipeline.run(spark, sf).collect()
    want = {k: t if k == 1 else t.splitlines()[0] for k, t in good.items()}
    want |= {21: shared[21], 22: " ".join(w for w in shared[22].split() if w not in set(passage.split()))}
    want[11] = ""  # every line of it stood earlier: an empty document stays a row
    tokens = load_tokenizer(tokenizer_path(packing.VOCABULARY))
    assert {(r.doc_id, r.length) for r in packed} == {(k, len(tokens.encode(re.sub(r"\s+$", "", t), add_special_tokens=False).ids) + 1) for k, t in want.items()}
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "substring_dedup", "best_fit_packing"]
