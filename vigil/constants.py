"""The defaults of the operators."""

# Feature matrix
FEATURES = (
    "std_rush_order", "avg_rush_order", "std_trades", "std_volume", "avg_volume", "std_price",
    "avg_price", "avg_price_max", "hour_sin", "hour_cos", "minute_sin", "minute_cos",
)
ROLLING_CHUNKS = {"25S": 900, "15S": 900, "5S": 700}
BIN_SECONDS = {"25S": 25, "15S": 15, "5S": 5}
PRICE_CHUNKS = 10
ROUND_DIGITS = 3
WARMUP_DAYS = 14
MINUTES_A_DAY = 1440

# Detectors
ANCHOR = 0.5
STAR = {"25S": 0.7036605405579714, "15S": 0.5059013502406946, "5S": 0.3382249603958512}
COOLDOWN_SECONDS = 1800
Z_THRESHOLD, Z_SUM_MINUTES, Z_TRAIL_MINUTES = 4.0, 5, 1440
JUMP_THRESHOLD, JUMP_MINUTES = 0.05, 5
FLOORS = {"upstream_rf": 0.05, "volume_zscore": 2.0, "price_jump": 0.01}
FOREST = {"numTrees": 200, "maxDepth": 5, "minInstancesPerNode": 1, "seed": 1}

# Endpoints
BOOTSTRAP_DRAWS, BOOTSTRAP_SEED, BOOTSTRAP_ALPHA = 2000, 20260722, 0.05
HOURS_A_PAIR_DAY, RATE_SCALE = 24.0, 1000.0
EXCLUDED_DATES = ("2026-07-20",)
REINSTATED, LAST_DEFECTIVE_TABLE = ("JUPUSDT", "SYRUPUSDT"), "2026-07-31"
STREAM_START, STREAM_DAYS = "2026-07-24", 84
STRATA = 3
TOP_EXCLUDED, TRAILING_DAYS, LISTING_GAP_DAYS, PUBLICATION_LAG_DAYS = 50, 30, 5, 2
SAMPLE_SIZE, STRUCTURAL_SAMPLE, SAMPLE_SEED = 100, 12, 20260722
GATE_VENUES, GATE_SHARE = 2, 0.60

# Signature rules: name, gain, volume factor, retrace share, gain window, retrace window
RULES = (
    ("primary", 0.25, 10.0, 0.5, 5, 60),
    ("loose", 0.15, 5.0, 0.4, 5, 60),
    ("strict", 0.35, 20.0, 0.6, 5, 60),
    ("window10", 0.25, 10.0, 0.5, 10, 60),
)
SIGNATURE_TRAIL = 1440

VERDICTS = ("match", "no-match", "unclear")
EPISODE_COLUMNS = ("pair", "ts_utc", "detector", "threshold", "score", "threshold_label", "frequency", "ts_available_utc", "day")
CANDIDATE_COLUMNS = ("pair", "ts_utc", "detector", "frequency", "score", "day")

# Base assets that are never eligible.  Leveraged tokens match exactly, not by their endings.
LEVERAGED_BASES = (
    "BTCUP", "BTCDOWN", "ETHUP", "ETHDOWN", "BNBUP", "BNBDOWN", "ADAUP", "ADADOWN", "XRPUP", "XRPDOWN", "DOTUP", "DOTDOWN",
    "LINKUP", "LINKDOWN", "LTCUP", "LTCDOWN", "EOSUP", "EOSDOWN", "TRXUP", "TRXDOWN", "BCHUP", "BCHDOWN", "AAVEUP", "AAVEDOWN",
    "SUSHIUP", "SUSHIDOWN", "UNIUP", "UNIDOWN", "XLMUP", "XLMDOWN", "FILUP", "FILDOWN", "YFIUP", "YFIDOWN", "1INCHUP", "1INCHDOWN",
    "SXPUP", "SXPDOWN", "XTZUP", "XTZDOWN", "BULL", "BEAR", "ETHBULL", "ETHBEAR", "EOSBULL", "EOSBEAR", "XRPBULL", "XRPBEAR", "BNBBULL", "BNBBEAR",
)
STABLE_FIAT_BASES = (
    "USDC", "FDUSD", "TUSD", "DAI", "BUSD", "USDP", "PAX", "PAXG", "EUR", "EURI", "AEUR", "GBP", "AUD", "BRL", "TRY", "RUB", "UAH",
    "NGN", "ZAR", "BIDR", "IDRT", "GYEN", "VAI", "UST", "USTC", "SUSD", "USDS", "USD1", "USDE", "XUSD", "BKRW", "COP", "ARS", "MXN", "JPY", "PLN", "RON", "CZK",
)
