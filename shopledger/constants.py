"""Fixed values. They are part of the data contract (file names, headers, account codes, labels, rates), not tuning."""

from decimal import Decimal

#: Column with the place of a row in its input: number of the file in its dataset, part file, start of the split, row in it.
INPUT_POSITION = "_input"

# ---- fixed values: currency -------------------------------------------------------------------
VND_PER_USD = Decimal("24708.655")
MONEY_SYMBOLS = "₫đ$€£"

# ---- fixed values: tokens that mean "no value" -------------------------------------------------
NULL_TOKENS = ("--", "N/A", "", " ")
NULL_WORDS = ("nan", "none", "null")
NULL_STRINGS = ("None", "none", "NONE", "null", "NULL", "nan", "NaN", "", " ")

# ---- fixed values: date formats of the raw files -----------------------------------------------
STATEMENT_DATE = "MMMM d, yyyy"
DEPOSIT_DATE = "MMMM d, yyyy"
SHORT_DATE = "M/d/yy"
LONG_DATE = "M/d/yyyy"
BANK_DATE = "d/M/yyyy"

# ---- fixed values: file-name pattern -> dataset, in lookup order -------------------------------
FILE_PATTERNS = (
    ("EtsyListingsDownload.csv", "listing"),
    ("EtsySoldOrders", "sold_orders"),
    ("EtsySoldOrderItems", "sold_order_items"),
    ("etsy_statement_", "statement"),
    ("EtsyDeposits", "deposits"),
    ("EtsyDirectCheckoutPayments", "direct_checkout"),
    ("fact_bank_transactions.csv", "bank_transactions"),
    ("product_catalog.csv", "product_catalog"),
    ("dim_bank_account.csv", "dim_bank_account"),
)
MANIFEST_NAME = "manifest.json"

# ---- fixed values: header rules (required columns; groups of which one must be present) --------
HEADER_RULES = {
    "statement": (["Date", "Type", "Currency"], [["Amount", "Fees & Taxes", "Net"]]),
    "direct_checkout": (["Order Date", "Currency"], [["Gross Amount", "Net Amount", "Posted Gross", "Posted Net"]]),
    "listing": (["TITLE"], []),
    "sold_order_items": (["Order ID", "Listing ID", "Sale Date"], [["Price", "Item Total"]]),
    "sold_orders": (["Order ID", "Sale Date"], [["Order Value", "Order Total"]]),
    "deposits": (["Date", "Amount", "Currency"], []),
    "product_catalog": (
        [],
        [
            ["Product Line ID"],
            ["Product Line Name", "Product Line"],
            ["Product ID"],
            ["Product Name", "Product"],
            ["Variant ID"],
            ["Variant Name", "Variants"],
        ],
    ),
}
# A bank export needs one header that contains either word.
BANK_DESCRIPTION_WORDS = ("description", "diễn giải")
# Words that mark the header row of a bank export.
BANK_HEADER_WORDS = ("description", "diễn giải", "dien giai")

# ---- fixed values: catalog header (lower case) -> column ---------------------------------------
CATALOG_HEADERS = {
    "product line id": "product_line_id",
    "product line name": "product_line_name",
    "product line": "product_line_name",
    "product id": "product_id",
    "product name": "product_name",
    "product": "product_name",
    "variant id": "variant_id",
    "variant name": "variant_name",
    "variants": "variant_name",
}
CATALOG_KEY = ("product_line_id", "product_id", "variant_id")
CATALOG_NAMES = ("product_line_name", "product_name", "variant_name")

# ---- fixed values: bank export headers, first rule that matches wins ---------------------------
# (column, words of which one must appear, words of which one must appear too)
BANK_HEADERS = (
    ("transaction_date", ("transaction date", "ngày gd", "ngay gd"), ()),
    ("reference_number", ("reference", "mã giao dịch", "ma giao dich"), ()),
    ("account_number", ("account number",), ("truy vấn", "truy van")),
    ("account_name", ("account name",), ("truy vấn", "truy van")),
    ("opening_date", ("opening date", "ngày mở", "ngay mo"), ()),
    ("credit_amount", ("credit amount", "phát sinh có", "phat sinh co"), ()),
    ("debit_amount", ("debit amount", "phát sinh nợ", "phat sinh no"), ()),
    ("balance_after_transaction", ("balance", "số dư", "so du"), ()),
    ("transaction_description", ("description", "diễn giải", "dien giai"), ()),
)

# ---- fixed values: profit-and-loss accounts ----------------------------------------------------
# account -> (profit-and-loss column, label in the cost breakdown)
COGS_ACCOUNTS = {
    "6211": ("material_cost", "Material cost (Yarn)"),
    "6221": ("concept_design_cost", "Concept design cost"),
    "6222": ("chart_hook_spin_cost", "Chart + hook + spinning"),
    "6223": ("spinning_cost", "Spinning cost"),
    "6224": ("photo_spin_cost", "Photo + video cost"),
    "6225": ("pattern_translation_cost", "Pattern & translation"),
}
OPERATING_ACCOUNTS = {
    "6273": ("general_production_cost", "Production overhead"),
    "6411": ("staff_cost", "Selling staff cost"),
    "6412": ("material_packaging_cost", "Materials & packaging (selling)"),
    "6413": ("platform_tool_cost", "Platform tools cost (selling)"),
    "6414": ("tool_cost", "Tools cost (selling)"),
    "6421": ("management_staff_cost", "Admin staff cost"),
    "6428": ("marketing_staff_cost", "Marketing & channel management"),
}
PL_ACCOUNTS = {**COGS_ACCOUNTS, **OPERATING_ACCOUNTS}

# ---- fixed values: fee lines of the statement --------------------------------------------------
# (profit-and-loss column, statement type, title fragment or None, name in the fee breakdown)
FEE_LINES = (
    ("transaction_fee", "Fee", "Transaction fee", "Transaction Fee"),
    ("processing_fee", "Fee", "Processing fee", "Processing Fee"),
    ("regulatory_fee", "Fee", "Regulatory Operating fee", "Regulatory Operating Fee"),
    ("listing_fee", "Fee", "Listing fee", "Listing Fee"),
    ("marketing_fee", "Marketing", None, "Marketing"),
    ("vat_auto_renew_sold", "VAT", "auto-renew sold", "VAT - auto-renew sold"),
    ("vat_shipping_transaction", "VAT", "shipping_transaction", "VAT - shipping_transaction"),
    ("vat_processing_fee", "VAT", "Processing Fee", "VAT - Processing Fee"),
    ("vat_transaction_credit", "VAT", "transaction credit", "VAT - transaction credit"),
    ("vat_listing_credit", "VAT", "listing credit", "VAT - listing credit"),
    ("vat_listing", "VAT", "listing", "VAT - listing"),
    ("vat_plus_subscription", "VAT", "Etsy Plus subscription", "VAT - Etsy Plus subscription"),
)

# ---- fixed values: items subtracted from revenue by default, with labels -----------------------
PROFIT_ITEMS = {
    "refund_cost": "Refund Cost",
    "cost_of_goods": "Cost of Goods",
    "total_platform_fees": "Etsy Fees",
    "general_production_cost": "Chi phí sản xuất chung",
    "staff_cost": "Chi phí nhân viên (Chi phí bán hàng)",
    "material_packaging_cost": "Chi phí nguyên vật liệu, bao bì (Chi phí bán hàng)",
    "platform_tool_cost": "Chi phí dụng cụ tool sàn (Chi phí bán hàng)",
    "tool_cost": "Chi phí dụng cụ tool (Chi phí bán hàng)",
    "management_staff_cost": "Chi phí nhân viên quản lý (Chi phí quản lý doanh nghiệp)",
    "marketing_staff_cost": "Chi phí nhân viên marketing - đăng và quản lí kênh (Chi phí quản lý doanh nghiệp)",
}

# ---- fixed values: lines of the profit-and-loss statement, in order (None = heading) -----------
STATEMENT_LINES = (
    ("Revenue (Sales)", None),
    ("Revenue", "revenue"),
    ("", None),
    ("Refund Cost", "refund_cost"),
    ("COGS (Cost of Goods Sold)", None),
    ("Cost of Goods", "cost_of_goods"),
    ("  - Chi phí len (Chi phí nguyên liệu, vật liệu trực tiếp)", "material_cost"),
    ("  - Chi phí làm concept design (Chi phí nhân công trực tiếp)", "concept_design_cost"),
    ("  - Chi phí làm chart + móc + quay (optional) (Chi phí nhân công trực tiếp)", "chart_hook_spin_cost"),
    ("  - Chi phí quay (Chi phí nhân công trực tiếp)", "spinning_cost"),
    ("  - Chi phí chụp + quay (Chi phí nhân công trực tiếp)", "photo_spin_cost"),
    ("  - Chi phí viết pattern - dịch chart (Chi phí nhân công trực tiếp)", "pattern_translation_cost"),
    ("Operating Expenses", None),
    ("Etsy Fees", "total_platform_fees"),
    ("  - Transaction Fee", "transaction_fee"),
    ("  - Processing Fee", "processing_fee"),
    ("  - Regulatory Operating Fee", "regulatory_fee"),
    ("  - Listing Fee", "listing_fee"),
    ("  - Marketing", "marketing_fee"),
    ("  - VAT", "total_vat_fees"),
    ("    --- auto-renew sold", "vat_auto_renew_sold"),
    ("    --- shipping_transaction", "vat_shipping_transaction"),
    ("    --- Processing Fee", "vat_processing_fee"),
    ("    --- transaction credit", "vat_transaction_credit"),
    ("    --- listing credit", "vat_listing_credit"),
    ("    --- listing", "vat_listing"),
    ("    --- Etsy Plus subscription", "vat_plus_subscription"),
    ("Chi phí sản xuất chung", "general_production_cost"),
    ("Chi phí nhân viên (Chi phí bán hàng)", "staff_cost"),
    ("Chi phí nguyên vật liệu, bao bì (Chi phí bán hàng)", "material_packaging_cost"),
    ("Chi phí dụng cụ tool sàn (Chi phí bán hàng)", "platform_tool_cost"),
    ("Chi phí dụng cụ tool (Chi phí bán hàng)", "tool_cost"),
    ("Chi phí nhân viên quản lý (Chi phí quản lý doanh nghiệp)", "management_staff_cost"),
    ("Chi phí nhân viên marketing - đăng và quản lí kênh (Chi phí quản lý doanh nghiệp)", "marketing_staff_cost"),
    ("Net Income (Profit)", None),
    ("Profit", "net_profit"),
)
FULL_YEAR = "Full Year"

# ---- fixed values: word cascades of the statement type (first match wins) ----------------------
REVENUE_WORDS = (
    ("Sale", ("sale", "order", "item")),
    ("Deposit", ("deposit", "payout")),
    ("Refund", ("refund", "return")),
    ("Fee", ("fee", "charge")),
    ("Tax", ("tax",)),
)
FEE_WORDS = (
    ("Transaction Fee", "transaction"),
    ("Listing Fee", "listing"),
    ("Payment Processing", "payment"),
    ("Advertising", "advertising"),
    ("Regulatory Fee", "regulatory"),
)

# ---- fixed values: order status spelling -------------------------------------------------------
ORDER_STATUSES = ("Completed", "Processing", "Shipped", "Delivered", "Cancelled", "Refunded")

# ---- fixed values: listing description, lines with one of these phrases are dropped ------------
DESCRIPTION_BOILERPLATE = (
    "Orders placed after",
    "WE HAVE DISCOUNT",
    "We also have discount",
    "WE OFFER BULK ORDER",
    "please note if you want to order large quantity",
    "If you need any else",
    "Thank you.",
    "If you have any querries",
    "please kindly message us",
    "Proud to be made in Viet Nam",
    "Made In Viet Nam",
    "Proud to be made in Vietnam.",
    "Proudly made in Vietnam.",
)

# ---- fixed values: listing description sections ------------------------------------------------
# A section runs from its heading to the next line that starts with one of SECTION_STARTS, or to a line end.
SECTION_STARTS = (
    "-",
    "Material",
    "Color",
    "HOW",
    "Product package",
    "Proudly",
    "Fit for",
    "How to",
    "Package",
    "Hand Fan Dimension",
    r"\* Instructions",
    "Kindly note",
)
# field -> headings, tried in order
SECTION_HEADINGS = {
    "material": (r"(?:- )?Material:\s*",),
    "dimensions": (r"(?:- )?(?:Product dimension|Dimension|Hand Fan Dimension|DIMENSION):\s*",),
    "color": (r"(?:- )?Color:\s*",),
    "how_made": (r"(?:- )?(?:How was it made|How it was made|HOW IT WAS MADE):\s*",),
    "package": (r"(?:- )?Product package:\s*", r"Package:\s*"),
    "instructions": (
        r"\* Instructions for use and care:\s*",
        r"- The product should be kept in a dry place\.",
    ),
    "how_use": (r"(?:- )?(?:How to use|How to refill):\s*",),
    "fit_for": (r"Fit for standard tissue box\s*",),
}
# The story is the text before the first line that starts with one of these.
STORY_ENDS = (
    "Dimension",
    "DIMENSION",
    "- Dimension",
    "- Material",
    "Material",
    "Hand Fan Dimension",
    "- Product dimension",
    "- How",
    "Fit for",
    "Package",
    "- Color",
    "HOW IT WAS MADE",
    r"\* Instructions",
)
HANDMADE_NOTE_PATTERN = (
    r"Kindly note since this is a handmade product, the size will vary from \+-2 cm\. "
    r"Please read carefully about the size before making your purchase\."
)
HANDMADE_NOTE = "Handmade product, size may vary ±2 cm."
COUNTRY_OF_ORIGIN = "Vietnam"

# ---- fixed values: seasons ---------------------------------------------------------------------
RETAIL_SEASONS = {
    1: "Winter/Post-Holiday",
    2: "Winter/Valentine",
    3: "Spring",
    4: "Spring/Easter",
    5: "Spring/Mother Day",
    6: "Summer",
    7: "Summer",
    8: "Back-to-School",
    9: "Fall/Halloween",
    10: "Fall/Halloween",
    11: "Holiday Season",
    12: "Holiday Season",
}
SELLING_SEASONS = (
    ("Holiday", (11, 12, 1)),
    ("Back-to-School", (8, 9)),
    ("Spring", (4, 5)),
    ("Summer", (6, 7)),
)
PEAK_MONTHS = (11, 12, 1, 2)
CALENDAR_START, CALENDAR_END = "2020-01-01", "2030-12-31"

# ---- fixed values: country lookups (value per country, then the default) -----------------------
HOME_COUNTRY = "United States"
CONTINENTS = (
    {
        "United States": "North America",
        "Canada": "North America",
        "Mexico": "North America",
        "United Kingdom": "Europe",
        "Germany": "Europe",
        "France": "Europe",
        "Australia": "Oceania",
        "Japan": "Asia",
    },
    "Unknown",
)
REGIONS = (
    {
        "United States": "North America",
        "Canada": "North America",
        "United Kingdom": "Western Europe",
        "Germany": "Western Europe",
        "Australia": "Asia Pacific",
    },
    "Other",
)
MARKETS = ({"United States": "US", "United Kingdom": "EU", "Germany": "EU", "France": "EU"}, "International")
CURRENCIES = (
    {
        "United States": "USD",
        "Canada": "CAD",
        "United Kingdom": "GBP",
        "Germany": "EUR",
        "France": "EUR",
        "Australia": "AUD",
        "Japan": "JPY",
    },
    "USD",
)
TIME_ZONES = (
    {
        "United States": "America/New_York",
        "Canada": "America/Toronto",
        "United Kingdom": "Europe/London",
        "Germany": "Europe/Berlin",
        "Australia": "Australia/Sydney",
    },
    "UTC",
)

# ---- fixed values: end of validity of a current dimension row ----------------------------------
OPEN_END = "2262-04-11 00:00:00"

# ---- fixed values: business keys and the facts that point at each dimension --------------------
# dimension -> (business key, surrogate key, ((fact, foreign key), ...))
MERGE_KEYS = {
    "dim_product": (
        "listing_id",
        "product_key",
        (("fact_sales", "product_key"), ("fact_financial_transactions", "product_key")),
    ),
    "dim_customer": (
        "buyer_user_name",
        "customer_key",
        (
            ("fact_sales", "customer_key"),
            ("fact_financial_transactions", "customer_key"),
            ("fact_payments", "customer_key"),
        ),
    ),
    "dim_order": (
        "order_id",
        "order_key",
        (("fact_sales", "order_key"), ("fact_financial_transactions", "order_key"), ("fact_payments", "order_key")),
    ),
    "dim_geography": ("location_hash", "geography_key", (("fact_sales", "geography_key"),)),
    "dim_payment": (
        "payment_method",
        "payment_key",
        (("fact_sales", "payment_key"), ("fact_payments", "payment_method_key")),
    ),
    "dim_bank_account": ("account_number", "bank_account_key", (("fact_bank_transactions", "bank_account_key"),)),
}
FACT_KEYS = {
    "fact_sales": ("sales_key", "sale_date_key"),
    "fact_financial_transactions": ("financial_transaction_key", "transaction_date_key"),
    "fact_deposits": ("deposit_key", "deposit_date_key"),
    "fact_payments": ("payment_transaction_key", "payment_date_key"),
    "fact_bank_transactions": ("bank_transaction_key", "transaction_date_key"),
}

# ---- fixed values: money columns of the star tables --------------------------------------------
STAR_MONEY = {
    "dim_order": (
        "order_value",
        "discount_amount",
        "shipping_discount",
        "shipping",
        "sales_tax",
        "order_total",
        "card_processing_fees",
        "order_net",
        "adjusted_order_total",
        "adjusted_card_processing_fees",
        "adjusted_net_order_amount",
    ),
    "dim_product": ("price",),
    "fact_sales": (
        "item_price",
        "item_total",
        "discount_amount",
        "shipping_amount",
        "shipping_discount",
        "order_sales_tax",
        "vat_paid_by_buyer",
    ),
    "fact_financial_transactions": ("amount", "fees_and_taxes", "net", "tax_details"),
    "fact_deposits": ("deposit_amount",),
    "fact_payments": (
        "gross_amount",
        "fees",
        "net_amount",
        "posted_gross",
        "posted_fees",
        "posted_net",
        "adjusted_gross",
        "adjusted_fees",
        "adjusted_net",
        "listing_amount",
        "vat_amount",
        "refund_amount",
    ),
    "fact_bank_transactions": ("credit_amount", "debit_amount", "balance_after_transaction"),
}

# ---- fixed values: raw columns that hold money, dates or text to tidy, per dataset -------------
STATEMENT_MONEY = ("Amount", "Fees & Taxes", "Net", "Tax Details")
ORDER_DATES = ("Sale Date", "Order Date", "Ship Date", "Date Shipped")
ORDER_NUMBERS = ("Order Value", "Discount Amount", "Order Total", "Number of Items", "Card Processing Fees", "Order Net")
ORDER_VND = ("Card Processing Fees", "Order Net")
ORDER_TEXT = ("Full Name", "First Name", "Last Name", "Buyer", "Order Status")
ORDER_ADDRESS = ("Address1", "Address2", "City", "State", "Country", "Zip")
ITEM_NUMBERS = ("Price", "Quantity", "Total", "Item Total")
ITEM_TEXT = ("Title", "Category", "Materials", "Tags")
CHECKOUT_MONEY = ("Gross Amount", "Fees", "Net Amount", "Posted Gross", "Posted Fees", "Posted Net")

# ---- fixed values: ids in a bank description ---------------------------------------------------
# line_product_variant, then optionally a four-digit account after blanks or underscores
DESCRIPTION_PATTERN = r"(?i)([A-Z0-9]+)_([A-Z0-9]+)_([A-Z0-9]+)(?:[_\s]+(\d{4}))?"
