"""Record schemas and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

# Record layouts with their field names. Fixed values.
CAR_COUNT = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("location", T.StringType()),
    T.StructField("count", T.LongType()),
])

_DATE = "struct<year:int,monthValue:int,dayOfMonth:int>"
_DATE_TIME = "struct<year:int,monthValue:int,dayOfMonth:int,hour:int,minute:int>"
_HORSE = "struct<name:string,id:bigint>"

EVENT = (
    f"struct<id:bigint,name:string,date:{_DATE},races:array<struct<id:bigint,hasRun:boolean,"
    f"currentVersion:struct<odds:map<string,double>,raceTime:{_DATE_TIME},version:bigint,"
    f"runners:array<{_HORSE}>>,winner:{_HORSE}>>>"
)
LEG = "struct<race:bigint,backing:bigint,oddsVersion:int,oddsType:string,odds:double,stake:double>"
BET = f"struct<id:bigint,stake:double,type:string,legs:array<{LEG}>>"
USER = f"struct<id:bigint,firstName:string,lastName:string,knownBets:array<{BET}>>"

CUSTOMER_ROW = "struct<id:int,first_name:string,last_name:string,email:string>"


def change_envelope(row: str = CUSTOMER_ROW) -> str:
    """Change-event schema around a table's row type (DDL text)."""
    return (
        f"struct<before:{row},after:{row},source:struct<ts_ms:bigint,snapshot:string,db:string,"
        "`table`:string,file:string,pos:bigint,`row`:int>,op:string,ts_ms:bigint>"
    )


# The record without a winner groups under this horse. Fixed values.
NO_WINNER_NAME = "DEATH"
NO_WINNER_ID = -(2 ** 63)

# Topic -> markers; the first marker is the display name. Fixed values.
COIN_MARKERS = {
    "BTC": ["Bitcoin", "#btc", "#bitcoin"],
    "ETH": ["Ether", "ethereum", "#eth", "#ether", "#ethereum"],
    "EOS": ["EOS", "#eos"],
    "XRP": ["Ripple", "#xrp", "#ripple"],
    "BCH": ["Bitcoin Cash", "#bitcoincash", "#bch"],
    "LTC": ["Litecoin", "#ltc", "#litecoin"],
    "XLM": ["Stellar", "#xlm", "#steller"],
}

# Window name -> length in ms, and the common slide. Fixed values.
WINDOW_SIZES = {"HALF_MINUTE": 30_000, "FIVE_MINUTES": 300_000}
WINDOW_SLIDE_MS = 200

# Diagnosis text -> tumour type. Fixed values.
TUMOUR_TYPES = {"B": "BENIGN", "M": "MALIGNENT"}

# Measures of a tumour row; each comes as mean, error and worst. Fixed values.
_MEASURES = ["radius", "texture", "perimeter", "area", "smoothness", "compactness",
             "concavity", "concave_points", "symmetry", "fractal_dimension"]
TUMOUR_FEATURES = [f"{m}_{s}" for s in ("mean", "se", "worst") for m in _MEASURES]
TUMOUR = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("diagnosis", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in TUMOUR_FEATURES]
)

# Review codes below the dictionary. Fixed values.
PAD_CODE, START_CODE, UNKNOWN_CODE, RESERVED_CODES, REVIEW_LENGTH = 0, 1, 2, 3, 256
