"""Word lists, lookup tables, patterns and constants that results depend on.

Everything here is data. The rules that use it are in ``functions`` and ``operators``.
"""

# --- labelling ---------------------------------------------------------------------------------

HIGH_PCT_FIXED = 3.0
MEDIUM_PCT_FIXED = 1.0
MIN_ROLLING_OBS = 30
ROLLING_WINDOW_DAYS = 90
OUTLIER_CAP_PCT = 20.0
LOW_QUANTILE = 0.33
HIGH_QUANTILE = 0.67
MIN_THRESHOLD_STEP = 0.3
MAX_ALIGN_GAP_DAYS = 3
MIN_TRADING_DATES = 5

ROUTING_RULES = [
    ("Oman", ["lng", "natural gas", "liquefied", "jkm", "henry hub", "ttf", "nbp", "regasification",
              "gas price", "spot gas", "lng terminal"]),
    ("WTI", ["wti", "west texas", "cushing", "shale", "permian", "eagle ford", "bakken", "us crude",
             "gulf coast", "usgc", "houston", "midland"]),
    ("Brent", ["brent", "north sea", "dated brent", "forties", "oseberg", "ekofisk", "europe", "urals",
               "russia", "norway", "uk crude", "rotterdam", "mediterranean"]),
    ("Dubai", ["dubai", "oman", "saudi", "abu dhabi", "kuwait", "iraq", "iran", "middle east", "gulf",
               "opec", "arab", "murban", "basrah", "arabian", "sour crude"]),
]
DEFAULT_SYMBOL = "Dubai"
ROUTING_BODY_CHARS = 200

LABEL_NOISE_REPORTS = [
    "Crude Oil Marketwire", "Arab Gulf Marketscan", "Gulf Arab Marketscan", "European Marketscan",
    "Latin American Wire", "Oilgram Price Report", "Bunkerwire", "Solventswire",
    "Asia-Pacific - Arab Gulf Marketscan", "North American Crude and Products Scan",
    "European Gas Daily", "European Power Daily",
]

# --- entities ----------------------------------------------------------------------------------

EVENT_RULES = [
    ("opec_decision", ["opec", "opec+", "quota", "production cut", "output cut", "opec meeting"]),
    ("sanctions", ["sanction", "embargo", "ban on", "restrict", "blocked"]),
    ("force_majeure", ["force majeure", "act of god", "unforeseeable"]),
    ("pipeline_outage", ["pipeline outage", "pipeline shutdown", "pipeline disruption",
                         "pipeline explosion"]),
    ("supply_disruption", ["outage", "shutdown", "disruption", "explosion", "fire at",
                           "refinery outage"]),
    ("geopolitical", ["war", "conflict", "tension", "attack", "military", "geopolit", "invasion",
                      "strike"]),
    ("demand_shock", ["demand surge", "demand spike", "demand collapse", "demand shock"]),
    ("lng_outage", ["lng outage", "lng plant", "lng terminal", "lng disruption", "lng shutdown"]),
    ("inventory_data", ["eia", "api inventory", "crude draw", "crude build", "inventory data",
                        "stock data"]),
    ("production_change", ["production change", "output change", "rig count", "shale output"]),
    ("refinery_maintenance", ["maintenance", "repair", "scheduled", "turnaround", "refinery"]),
    ("shipping_disruption", ["tanker", "ship", "vessel", "cargo", "freight", "strait", "hormuz",
                             "suez"]),
    ("demand_change", ["demand", "consumption", "import", "export", "forecast"]),
]
DEFAULT_EVENT = "other"

REGION_RULES = [
    ("europe", ["europe", "european", "germany", "uk", "france", "netherlands", "italy", "norway"]),
    ("middle_east", ["middle east", "saudi", "iran", "iraq", "uae", "kuwait", "qatar", "oman", "gulf"]),
    ("russia", ["russia", "russian", "moscow"]),
    ("asia", ["china", "japan", "korea", "asia", "india", "singapore", "malaysia"]),
    ("us", ["us", "usa", "american", "texas", "houston", "gulf of mexico"]),
]
DEFAULT_REGION = "global"

SUPPLY_IMPACT_WORDS = [
    "outage", "shutdown", "disruption", "sanction", "embargo", "cut", "maintenance", "repair",
    "explosion", "attack", "pipeline", "refinery", "tanker",
]

IMPACT_SCORES = {
    "opec_decision": 10, "sanctions": 9, "force_majeure": 9, "pipeline_outage": 8,
    "supply_disruption": 8, "geopolitical": 7, "demand_shock": 7, "lng_outage": 7,
    "inventory_data": 6, "production_change": 6, "refinery_maintenance": 5, "shipping_disruption": 5,
    "demand_change": 4, "analyst_comment": 3, "routine_report": 2, "price_movement": 1,
    "general_market": 1, "other": 2,
}
DEFAULT_IMPACT = 2

# Word lists of the quick scoring entities (a coarser set than the rules above).
QUICK_REGIONS = [
    ("middle_east", ["dubai", "oman", "saudi", "abu dhabi", "middle east", "gulf"]),
    ("asia", ["china", "singapore", "japan", "korea", "asia"]),
    ("us", ["us", "wti", "gulf coast", "cushing"]),
    ("russia", ["russia", "urals", "moscow"]),
    ("europe", ["europe", "brent", "north sea", "rotterdam"]),
]
QUICK_PIPELINE = ["pipeline", "terminal", "port shutdown"]
QUICK_SHIPPING = ["shipping", "tanker", "freight", "strait"]
QUICK_DEMAND = ["demand", "import", "export", "buying", "tender"]
QUICK_TIGHT = ["cut", "outage", "disruption", "sanction", "attack", "tight"]
QUICK_LOOSE = ["build", "restart", "surplus", "weak", "slower"]
QUICK_TIGHT_SENTIMENT = 0.35
QUICK_LOOSE_SENTIMENT = -0.25

BULL_WORDS = ["rise", "rises", "surge", "gain", "rally", "higher", "up", "increase", "tight", "cut",
              "outage", "disruption", "shortage", "sanction", "attack", "conflict", "opec cut"]
BEAR_WORDS = ["fall", "falls", "drop", "decline", "lower", "down", "decrease", "weak", "surplus",
              "oversupply", "build", "restart", "ease", "glut", "slow", "demand falls"]

CONTEXT_PANELS = [
    ("supply", ["outage", "shutdown", "disruption", "cut", "sanction", "opec", "pipeline", "refinery",
                "tanker", "attack", "shortage", "force majeure"]),
    ("demand", ["demand", "import", "consumption", "buying", "tender", "china", "india", "asia",
                "growth", "forecast"]),
    ("geopolitical", ["iran", "russia", "ukraine", "war", "conflict", "sanction", "geopolit", "hormuz",
                      "strait", "military", "tension"]),
]

# --- commodities -------------------------------------------------------------------------------

# commodity, canonical name, ticker, price code, market ticker, unit, currency, price symbol, stop %, group
COMMODITIES = [
    ("Dubai Crude (PCAAT00)", "Dubai Crude (PCAAT00)", "PCAAT00", "PCAAT00", "CL=F", "barrel", "USD", "Dubai", 1.5, "dubai"),
    ("Brent Dated (PCAAS00)", "Brent Dated (PCAAS00)", "PCAAS00", "PCAAS00", "BZ=F", "barrel", "USD", "Brent", 1.5, "brent"),
    ("WTI (PCACG00)", "WTI (PCACG00)", "PCACG00", "PCACG00", "CL=F", "barrel", "USD", "WTI", 1.5, "wti"),
    ("LNG / Nat Gas (JKM)", "LNG / Nat Gas (JKM)", "JKM", "AAVSV00", "NG=F", "MMBtu", "USD", "LNG", 2.0, "lng"),
    ("Dubai Crude", "Dubai Crude (PCAAT00)", "PCAAT00", "PCAAT00", "CL=F", "barrel", "USD", "Dubai", 1.5, "dubai"),
    ("Brent", "Brent Dated (PCAAS00)", "PCAAS00", "PCAAS00", "BZ=F", "barrel", "USD", "Brent", 1.5, "brent"),
    ("WTI", "WTI (PCACG00)", "PCACG00", "PCACG00", "CL=F", "barrel", "USD", "WTI", 1.5, "wti"),
    ("LNG", "LNG / Nat Gas (JKM)", "JKM", "AAVSV00", "NG=F", "MMBtu", "USD", "LNG", 2.0, "lng"),
]
COMMODITY_FIELDS = ["commodity", "canonical_name", "ticker", "price_code", "ticker_yf", "price_unit",
                    "price_currency", "price_symbol", "stop_pct", "commodity_group"]
DEFAULT_STOP_PCT = 1.5

# Roundtrip spread per commodity (USD per unit)
SPREAD_COSTS = {
    "Dubai Crude (PCAAT00)": 0.05, "Brent Dated (PCAAS00)": 0.04, "WTI (PCACG00)": 0.04,
    "LNG / Nat Gas (JKM)": 0.02,
}
DEFAULT_SPREAD = 0.05
SLIPPAGE = 0.0015

SIGNAL_KEYWORDS = [
    ("Dubai Crude (PCAAT00)", ["dubai", "oman", "saudi", "opec", "middle east", "gulf", "crude", "iran",
                               "iraq", "uae", "kuwait", "qatar", "barrel"]),
    ("Brent Dated (PCAAS00)", ["brent", "north sea", "europe", "russia", "urals", "norway", "uk",
                               "crude oil", "barrel"]),
    ("WTI (PCACG00)", ["wti", "cushing", "texas", "shale", "permian", "us crude", "american",
                       "gulf of mexico", "refinery"]),
    ("LNG / Nat Gas (JKM)", ["lng", "natural gas", "liquefied", "tanker", "cargo", "freight", "jkm",
                             "asia", "pacific", "shipping", "vessel", "hormuz"]),
]

GROUP_KEYWORDS = [
    ("dubai", ["dubai", "oman", "saudi", "abu dhabi", "kuwait", "iraq", "iran", "middle east", "gulf",
               "opec", "arab", "murban", "basrah", "pcaat", "pcaas", "arabian", "sour crude"]),
    ("brent", ["brent", "north sea", "dated brent", "forties", "oseberg", "ekofisk", "europe", "urals",
               "russia", "norway", "uk crude", "rotterdam", "mediterranean", "cif", "fob rotterdam"]),
    ("wti", ["wti", "west texas", "cushing", "shale", "permian", "eagle ford", "bakken", "us crude",
             "gulf coast", "usgc", "houston", "midland", "light sweet", "american crude"]),
    ("lng", ["lng", "natural gas", "liquefied", "jkm", "henry hub", "ttf", "nbp", "regasification",
             "cargo", "tanker", "vessel", "shipping", "gas price", "spot gas", "lng terminal",
             "lng export"]),
]
GENERAL_GROUP = "general"

# --- trading -----------------------------------------------------------------------------------

LOT_SIZE = 1000
NEUTRAL_RETURN_PCT = 0.20
TRADE_CONFIDENCE = 0.55
MAX_TRADES_PER_MONTH = 8
CUT_LOSS_RETURN_PCT = 2.0
MIN_EXPECTED_MOVE_PCT = 1.0
LOW_IMPACT_EVENTS = ["routine_report", "analyst_comment", "price_movement", "general_market"]
EXPECTED_MOVES = {">3%": 3.5, "1-3%": 2.0, "<1%": 0.5}
SAME_PRICE_TOLERANCE = 0.0001
EVALUATION_MOVE_PCT = 1.0
LARGE_MOVE_PCT = 3.0
LOW_SAMPLE = 30
MIN_ARTICLES = 5
WARN_ARTICLES = 20

# entry zone, target and stop of trade setups; moves as (min %, max %, middle %)
SETUP_TARGETS = {"HIGH": (2.0, 4.0, 3.0), "MEDIUM": (1.0, 2.0, 1.5), "LOW": (0.3, 1.0, 0.5)}
SETUP_STOPS = {"HIGH": 1.0, "MEDIUM": 0.8, "LOW": 0.5}
SETUP_MIN_CONFIDENCE = 0.50
SETUP_BEST_RATIO = 1.5
DEFAULT_WIN_RATES = {"HIGH": 0.55, "MEDIUM": 0.48, "LOW": 0.40}
FALLBACK_WIN_RATE = 0.45
DEFAULT_VOLATILITY = 0.003

# price sources: tier 1 is the published price table, tier 2 the market download
TIER1 = "platts"
TIER2 = "yfinance"
CLOSE_TIER1_DAYS = 7
CLOSE_TIER2_DAYS = 5
NEXT_CLOSE_DAYS = 7

# --- report text -------------------------------------------------------------------------------

HTML_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"),
                 ("&quot;", '"')]

# case-insensitive, searched anywhere in the line
BOILERPLATE_PATTERNS = [
    r"\(continued on page \d+\)",
    r"www\.spglobal\.com",
    r"©\s*\d{4}\s*by\s*S&P",
    r"all rights reserved",
    r"^\s*page \d+\s*$",
    r"^\s*\d+\s*$",
    r"^bid\s+ask\s+mid",
    r"^mid\s+change",
    r"^\$\s*/\s*b(arrel)?",
    r"^pga page \d+",
    r"platts\s+connect",
    r"^\s*\(?\d{1,3}\s*\$\s*/\s*[bm]\)?",
]
# fixed words of the patterns above that are not anchored at the start of a line
BOILERPLATE_HINTS = ["continued on page", "www.spglobal.com", "©", "all rights reserved", "platts"]
TABLE_HEADERS = (
    r"^(middle east|north sea|west africa|latin america|key benchmarks|forward dated brent|"
    r"brent/wti spreads|crude oil differentials|market table|price table|bid\s+ask\s+mid|contents)\s*$"
)
NARRATIVE_MARKERS = (
    r"(market commentary|analysis|outlook|summary|supply|demand|opec|geopolit|refinery|pipeline|"
    r"disruption|sanction|production|export|import)"
)
PRICE_LINE_MAX_CHARS = 300
PRICE_PATTERN_MAX_CHARS = 150
PRICE_LINE_DIGIT_SHARE = 0.45
NARRATIVE_ALPHA_SHARE = 0.40
NARRATIVE_MIN_WORDS = 5
NARRATIVE_MIN_CHARS = 50

GENERIC_HEADLINES = [
    "crude oil marketwire", "oilgram price report", "latin american wire", "north american crude",
    "arab gulf marketscan", "european marketscan", "asia-pacific", "bunkerwire", "us marketscan",
    "lpgaswire", "clean tankerwire", "gas daily", "energy trader", "megawatt daily",
    "fiber marketscan", "petrochemicalscan", "weekly oil", "weekly analysis", "market pulse",
    "doe weekly", "japan weekly", "iea oil report", "[application/pdf]",
]
GENERIC_HEADLINE_MIN_CHARS = 10

NEWS_NOISE_NAMES = [
    "crude oil marketwire", "arab gulf marketscan", "gulf arab marketscan", "european marketscan",
    "latin american wire", "oilgram price report", "bunkerwire", "energy trader", "gas daily",
    "megawatt daily", "us marketscan", "rec daily", "asia-pacific - arab gulf marketscan",
]
QUALITY_EXCLUDED_WORDS = ["marketwire", "marketscan", "oilgram", "bunkerwire"]
REAL_NEWS_BODY_CHARS = 500
REAL_NEWS_HEADLINE_CHARS = 40

TRAIN_BODY_CAP = 5000
TRAIN_SNIPPET_CHARS = 400
TRAIN_SNIPPET_MIN_CHARS = 200

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# --- report price tables -----------------------------------------------------------------------

# declared order decides which symbol wins
SYMBOL_ALIASES = [
    ("Dubai", ["dubai (may)", "dubai (jun)", "dubai (jul)", "dubai"]),
    ("Brent", ["brent (dated)", "dated north sea light", "dated brent", "brent"]),
    ("WTI", ["wti fob usgc", "wti"]),
    ("Oman", ["oman (may)", "oman (jun)", "oman"]),
]
# the extraction payload accepts one Brent alias fewer
PAYLOAD_ALIASES = [
    ("Dubai", ["dubai (may)", "dubai (jun)", "dubai (jul)", "dubai"]),
    ("Brent", ["brent (dated)", "dated brent", "brent"]),
    ("WTI", ["wti fob usgc", "wti"]),
    ("Oman", ["oman (may)", "oman (jun)", "oman"]),
]
EXCLUDED_CODE_PREFIX = "DBD"
EXCLUDED_ROW_LABEL = "spread vs dubai"
SECTION_START = ["key benchmarks", "middle east"]
SECTION_END = ["market commentary", "contents", "platts espo", "forward dated brent",
               "brent/wti spreads and efps"]
SECTION_HEADER_LINES = ["bid ask mid change", "mid change", "110 ($/b)"]
EVIDENCE_CHARS = 160
SIGNAL_IMPACTS = ["bullish", "bearish", "neutral"]
FILE_DATE_PATTERNS = [r"(\d{4})[-_](\d{2})[-_](\d{2})", r"(\d{2})[-_](\d{2})[-_](\d{4})",
                      r"(\d{4})(\d{2})(\d{2})"]

# --- models ------------------------------------------------------------------------------------

NUMERIC_FEATURES = ["mom_5d", "mom_10d", "dow_mon", "dow_tue", "dow_wed", "dow_thu", "dow_fri",
                    "article_count"]
CV_FOLDS = 4
MIN_FOLD_TRAIN = 50
MIN_FOLD_TEST = 20
MIN_SAMPLES = 40
EMBEDDING_MODEL_WEIGHT = 1.5
LOGISTIC_MAX_ITER = 2000
LOGISTIC_TOLERANCE = 1e-4
LOGISTIC_MAX_FEATURES = 15000
TREE_MAX_FEATURES = 15000
EMBEDDING_MAX_FEATURES = 10000
GROUP_MAX_FEATURES = 8000
TREE_TOP_TERMS = 500
EMBEDDING_TOP_TERMS = 300
VALIDATION_TREES = {"trees": 200, "depth": 4, "step": 0.1}
FINAL_TREES = {"trees": 300, "depth": 5, "step": 0.08}
EMBEDDING_TREES = {"trees": 400, "depth": 5, "step": 0.07}
TREE_ROW_SHARE = 0.8
TREE_COLUMN_SHARE = "0.8"
MIN_WEIGHT_ROWS = 10
EMPTY_ENSEMBLE = {"HIGH": 0.33, "LOW": 0.34, "MEDIUM": 0.33}
SIMILAR_MIN_CHARS = 15
SIMILAR_HEADLINE_CHARS = 300
