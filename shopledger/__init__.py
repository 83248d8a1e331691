"""Online-shop analytics as composable PySpark DataFrame functions.

Layers, bottom up:

* ``functions``  Column -> Column expressions (text, money, dates, ids, listings, bank text)
* ``sources``    CSV/bank-export readers, header checks, Parquet and CSV sinks
* ``operators``  cleaners, dimension and fact builders, merges, deletes, filters
* ``plans``      whole jobs: star build, KPI, profit and loss, product cost, bank reports
* ``streaming``  file-stream ingest
* ``registry``   the driver tables shaped as shop data, the query list and its SQL twins
"""
