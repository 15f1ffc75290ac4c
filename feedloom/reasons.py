"""The reason texts of filters, transforms and explain
records.  They must read exactly like this for explain output to match."""

# keyword filter
KEYWORD_EXCLUDED = "keyword_filter: dropped by exclude="
KEYWORD_NO_INCLUDE = "keyword_filter: dropped by no include match"
KEYWORD_SCORE = "keyword_filter: score="
KEYWORD_MIN_SCORE = "keyword_filter: dropped by min_score="
# domain filter
DOMAIN_EMPTY = "domain_filter: dropped by empty domain"
DOMAIN_EXCLUDED = "domain_filter: dropped by exclude domain="
DOMAIN_INCLUDE_MISMATCH = "domain_filter: dropped by include mismatch domain="
DOMAIN_KEPT = "domain_filter: domain="
DOMAIN_EMPTY_LABEL = "(empty)"
# time window
TIME_NO_WINDOW = "time_window_filter: no window"
TIME_MISSING = "time_window_filter: dropped by missing published time"
TIME_OLDER = "time_window_filter: dropped by older than "
TIME_WITHIN = "time_window_filter: within "
# hotness
HOTNESS_SCORE = "hotness_score: score="
MIN_HOTNESS_DROPPED = "min_hotness: dropped by min="
MIN_HOTNESS_DROPPED_SCORE = " score="
MIN_HOTNESS_SCORE = "min_hotness: score="
# favourite users
FAV_NONE_CONFIGURED = "fav_user: no users configured"
FAV_NO_MATCH = "fav_user: dropped by no matching user"
FAV_MATCHED = "fav_user: matched="
# merge and rank
MERGE_KEPT = "merge: kept key="
MERGE_DROPPED = "merge: dropped duplicate key="
EMPTY_KEY_PREFIX = "__index_"
RANK_BY = "rank: by="
RANK_UNSUPPORTED = "rank: unsupported rank "
# transforms and dry runs
NORMALIZE = "normalize: set normalized_url/id"
SOURCE_LABEL = "source_label: set source label when available"
TAG = "tag: merge Hatena comment tags into categories"
SUMMARY = "summary: local extractive summary without external API"
OGP = "ogp: would fetch article URL and read OGP metadata"
CONTENT = "content: would fetch article URL and extract readable content"
HATENA_BOOKMARK = "hatena_bookmark: would call Hatena APIs"
PLUGIN_DRY_RUN = "plugin: dry-run command="
PLUGIN_ARGS = " args="
PLUGIN_TIMEOUT = " timeout="
UNKNOWN_STAGE = "stage: explain is not implemented; assuming kept"
# whole-record reasons
NO_CRITERIA = "no filter/rank criteria"
BUILDER_ERROR = "explain: "
