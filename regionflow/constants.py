"""Fixed values shared by every operator.

Everything here is plain data: thresholds, word lists, character ranges and
marker strings.  Operators take these as defaults of real parameters.
"""

# --- fixed values: detection -------------------------------------------------
DETECTION_THRESHOLD = 0.5
CROP_PADDING = 5
ROW_BAND = 100          # reading order: height of one band in pixels
CONTEXT_PAD = 64
MODEL_MULTIPLE = 8

# --- fixed values: grid layout -----------------------------------------------
GRID_PADDING = 30
GRID_WIDTH = 600
GRID_MAX_HEIGHT = 4000
SEPARATOR_WIDTH = 6

# --- fixed values: line to cell mapping --------------------------------------
MATCH_TOLERANCE = 15
NEAR_MISS_DISTANCE = 50
DPI_TOLERANCE = 1.01

# --- fixed values: characters ------------------------------------------------
# A: characters that make an OCR line worth mapping.
CJK_MAP = "\u3040-\u30ff\u4e00-\u9fff\uff65-\uff9f\uac00-\ud7af\u1100-\u11ff"
# B: characters counted by the script ratio.
CJK_RATIO = (
    "\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af"
    "\u1100-\u11ff\u3130-\u318f\uff66-\uff9f"
)
# C: characters that show a translation was left in the source language.
CJK_UNTRANSLATED = "\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7af"
SKIP_CHARS = ["ノ", "ー", "一", "|"]
MIN_CJK_RATIO = 0.2

# --- fixed values: merging and batching --------------------------------------
LINE_LEVEL_COVERAGE = 0.7
STREAM_REGION_BATCH = 9
STREAM_TEXT_BATCH = 25
TRANSLATION_BATCH = 100
RETRY_BATCH = 20
RETRY_MAX_FAILED_SHARE = 0.5

# --- fixed values: markers ---------------------------------------------------
FAILED = "[TRANSLATION FAILED]"
NO_TEXT = "[NO TEXT]"
MISSING = "[MISSING]"
OCR_ERROR = "[OCR_ERROR]"
TRANSLATE_ERROR = "[TRANSLATE_ERROR]"
LOCAL_UNAVAILABLE = "[LOCAL_TRANSLATE_UNAVAILABLE]"
OUTPUT_TYPES = ["full_page", "speech_image_only", "text_only"]

# --- fixed values: reply preambles, in the order they are removed ------------
PREAMBLES = [
    r"^Here'?s the OCR (?:result|output)[^:]*:\s*",
    r"^OCR (?:result|output)[^:]*:\s*",
    r"^Following your (?:instructions|format)[^:]*:\s*",
    r"^```json\s*",
    r"\s*```$",
]

# --- fixed values: target languages without CJK script -----------------------
NON_CJK_TARGETS = [
    "english", "spanish", "french", "german", "portuguese", "italian",
    "russian", "arabic", "hindi", "thai", "vietnamese", "indonesian",
]

# --- fixed values: pixels ----------------------------------------------------
WHITE_LEVEL = 240
DARK_LEVEL = 128
MASK_TEXT_LEVEL = 5
MASK_STRONG_LEVEL = 127
TILE = 64

# --- fixed values: language names --------------------------------------------
LANGUAGES = [
    ("en", "English"), ("zh", "Chinese (Simplified)"),
    ("zh-TW", "Chinese (Traditional)"), ("ko", "Korean"), ("ja", "Japanese"),
    ("es", "Spanish"), ("fr", "French"), ("de", "German"),
    ("pt", "Portuguese"), ("ru", "Russian"), ("vi", "Vietnamese"),
    ("th", "Thai"), ("id", "Indonesian"),
]
MT_LANGUAGES = [
    ("zh", "Chinese", "中文"), ("zh-Hant", "Traditional Chinese", "繁体中文"),
    ("en", "English", "英语"), ("fr", "French", "法语"),
    ("pt", "Portuguese", "葡萄牙语"), ("es", "Spanish", "西班牙语"),
    ("ja", "Japanese", "日语"), ("tr", "Turkish", "土耳其语"),
    ("ru", "Russian", "俄语"), ("ar", "Arabic", "阿拉伯语"),
    ("ko", "Korean", "韩语"), ("th", "Thai", "泰语"),
    ("it", "Italian", "意大利语"), ("de", "German", "德语"),
    ("vi", "Vietnamese", "越南语"), ("ms", "Malay", "马来语"),
    ("id", "Indonesian", "印尼语"), ("tl", "Filipino", "菲律宾语"),
    ("hi", "Hindi", "印地语"), ("pl", "Polish", "波兰语"),
    ("cs", "Czech", "捷克语"), ("nl", "Dutch", "荷兰语"),
    ("km", "Khmer", "高棉语"), ("my", "Burmese", "缅甸语"),
    ("fa", "Persian", "波斯语"), ("gu", "Gujarati", "古吉拉特语"),
    ("ur", "Urdu", "乌尔都语"), ("te", "Telugu", "泰卢固语"),
    ("mr", "Marathi", "马拉地语"), ("he", "Hebrew", "希伯来语"),
    ("bn", "Bengali", "孟加拉语"), ("ta", "Tamil", "泰米尔语"),
    ("uk", "Ukrainian", "乌克兰语"), ("bo", "Tibetan", "藏语"),
    ("kk", "Kazakh", "哈萨克语"), ("mn", "Mongolian", "蒙古语"),
    ("ug", "Uyghur", "维吾尔语"), ("yue", "Cantonese", "粤语"),
]
CHINESE_TARGETS = ["zh", "zh-Hant", "yue"]
