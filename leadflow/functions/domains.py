"""Fixed values that must equal the product's own definitions.

These are data, not logic: domains of the lead attributes, the histogram
edges, the attribute list of the criteria report, limits and thresholds.
"""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# ---- fixed values (must match the product definitions exactly) ----

# columns of the two raw CSV drops
LEADS_SCHEMA = StructType([
    StructField("cif", StringType()),
    StructField("nama_program", StringType()),
    StructField("jenis_leads", StringType()),
    StructField("media_blasting", StringType()),
    StructField("periode_start", StringType()),
    StructField("flag_program", StringType()),
    StructField("wilayah", IntegerType()),
    StructField("cabang", IntegerType()),
    StructField("outlet", IntegerType()),
    StructField("segment_crs", StringType()),
    StructField("segment_by_aum", StringType()),
    StructField("segment_wondr", StringType()),
    StructField("segment_div_owner", StringType()),
    StructField("range_usia", StringType()),
    StructField("range_saldo_tab", DoubleType()),
    StructField("avg_aum_3_bln", DoubleType()),
    StructField("potensi_money", DoubleType()),
])

MONITORING_SCHEMA = StructType(LEADS_SCHEMA.fields + [
    StructField("take_up_flag", StringType()),
    StructField("take_up_date", StringType()),
    StructField("total_transaction_value", DoubleType()),
])

# lead attribute domains
MEDIA_BLASTING = ["wa", "digisales", "telesales", "email", "push notif", "sms"]
FLAG_PROGRAM = ["PROGRAM BIAYA ADMIN", "PROGRAM QRIS"]
SEGMENT_BY_AUM = ["UPPERMASS", "EMERALD", "MASS", "AFFLUENT", "PRIVATE", "HIGH AFFLUENT"]
RANGE_USIA = ["BABY BOOMER", "GEN X", "GEN Y", "GEN Z", "GEN ALPHA"]
SEGMENT_DIV_OWNER = ["CRS", "WEM (Perorangan)"]
WILAYAH_RANGE = (1, 17)
CABANG_RANGE = (1, 324)
OUTLET_RANGE = (0, 99)

# dimensions compared by the similarity index
SIMILARITY_DIMENSIONS = ["flag_program", "jenis_leads", "media_blasting"]

# accepted textual date formats, tried in this order (first success wins)
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "MM/dd/yyyy"]

# time-to-take-up histogram: [start, end) in days, last bin open
HISTOGRAM_BINS = [(0, 7), (7, 14), (14, 21), (21, 30), (30, 60), (60, 90), (90, None)]

# customer attributes of the criteria report
CUSTOMER_ATTRIBUTES = ["segment_by_aum", "range_usia", "media_blasting",
                       "segment_div_owner", "flag_program"]

# channel order used when suggesting channels not tried yet
CHANNEL_SUGGESTION_ORDER = ["wa", "digisales", "telesales", "email", "sms", "push notif"]

# personal data: the response filter's names and the lead model's customer id
PII_FIELDS = ["nama_lengkap", "nomor_rekening", "nomor_identitas", "alamat_lengkap", "cif"]

# similar-campaign lookup: text when nothing is similar, and the placeholder
# of the summary fields the index does not hold
NO_SIMILAR_MESSAGE = "Tidak ada campaign serupa ditemukan. Coba perluas dimensi pencarian."
NOT_AVAILABLE = "N/A"

# a lead's natural key; the columns the cleaning step writes in upper case
NATURAL_KEY = ["cif", "nama_program", "periode_start"]
UPPERCASE_COLUMNS = ["segment_by_aum", "range_usia", "flag_program", "media_blasting"]

# grouping keys of the campaign master
MASTER_KEYS = ["campaign_id", "nama_program", "flag_program", "jenis_leads",
               "media_blasting", "wilayah", "periode_start", "year", "month"]

# the overview roll-up: grouping keys, additive columns, columns in stored order
OVERVIEW_KEYS = ["period_start", "period_end", "granularity", "product", "channel", "region"]
OVERVIEW_SUMS = ["total_leads", "total_take_up", "total_transaction_value"]
OVERVIEW_COLUMNS = ["period_start", "period_end", "granularity", "product", "channel", "region",
                    "total_leads", "total_take_up", "take_up_rate", "total_transaction_value",
                    "campaign_count"]

# columns of the exported campaign table
EXPORT_COLUMNS = ["nama_program", "flag_program", "media_blasting", "jenis_leads", "wilayah",
                  "total_leads", "total_take_up", "take_up_rate"]

WEEKLY_MAX_DAYS = 90          # <= 90 days of campaign: weekly buckets, else monthly
MAX_SIMILAR_RESULTS = 20      # top-k cap of the similar-campaign lookup
MAX_REGION_TREND_WEEKS = 8    # weeks in the per-region trend
AUDIT_TTL_DAYS = 90           # audit rows expire after 90 days
SESSION_MAX_AGE_SECONDS = 28800   # 8 h session lifetime
REGION_MIN_LEADS = 2          # a region needs >= 2 leads to be called best
SEGMENT_LIFT_CAP = 8.0        # expected lift of the best segment is capped at 8 points
SIMILAR_GAIN_CAP = 10.0       # expected gain from the best similar campaign, cap 10 points
SIMILAR_HIGH_SCORE = 0.8      # similarity score giving HIGH confidence
FOLLOW_UP_MIN_DAYS = 7        # follow-up days = max(7, int(0.7 * avg days))
FOLLOW_UP_FACTOR = 0.7
DEFAULT_LOOKBACK_DAYS = 90    # overview window when no start date is given
RATE_BAND_HIGH = 10.0         # take-up rate badge: >= 10 high, >= 5 medium, else low
RATE_BAND_MEDIUM = 5.0
