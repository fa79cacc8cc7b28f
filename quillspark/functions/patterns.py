"""Fixed values of the text operators: ranges, word lists, patterns. They must equal what the operators are defined by.

All tables and patterns here are such values but for JUNK and BEFORE_JUNK, which say TRAILING_JUNK in two more ways.
"""

from quillspark.functions.dialect import WS

ARABIC_RANGES = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"
ARABIC = f"[{ARABIC_RANGES}]"
CONTROLS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FFF0}-\x{FFFF}\x{00AD}\x{061C}]"
TASHKEEL = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{08D4}-\x{08E1}]"
ALEF, YAA, KAF = "آأإ", "يىی", "کڪ"
GARBAGE_THRESHOLD = 0.35
BULLET = rf"^[•·‣⁃\-–—]{WS}"
_SOUND = rf"{ARABIC_RANGES}a-zA-Z0-9\t-\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}.,!?:;،؟؛()\]}}\-'\"»«﴿﴾"
#: What lines must not end with; the pattern after it finds the end of the rest in one go, from behind.
JUNK = f"[^{_SOUND}]"
TRAILING_JUNK = rf"{JUNK}+\z"
BEFORE_JUNK = rf"(?s)^((?:.*[{_SOUND}])?){JUNK}*+\z"

#: What lines that aren't garbled are made of.
KNOWN = rf"{ARABIC_RANGES}a-zA-Z0-9\-.,!?:;،؟؛\](){{}}\"'>&*%=@#«»"

LINE_END_WORDS = "من|في|عن|على|إلى|حتى|مذ|منذ|لدى|مع|غير|سوى|بين|تحت|فوق|دون|قبل|بعد|عند|نحو|حول|أو|أم|ثم|بل|لا|قد|هل|لم|لن|إن|أن|ما|هذا|هذه|ذلك|تلك|هو|هي|هم|هن|الذين|التي|الذي"
LINE_START_WORDS = (
    "و|ف|ب|ل|ك|فـ|بال|فلـ|ولـ|بل|هل|قد|سـ|فسـ|وسـ|لن|لم|لما|إن|أن|فإن|فأن|فقد|فهل|ولا|فلا|ولن|فلم|بأن|لكن|لعل|ليت|حيث|حين|عند|بين|بعد|قبل|تحت|فوق|مع|منذ|من|في|عن|على|إلى|حتى|حول|خلال|"
    "دون|نحو|غير|سوى|مثل|بسبب|بعدما|قبلما|حينما|كلما|أين|أينما|كيف|كيفما|أي|أيها|أيتها|يا"
)
LINE_START = rf"^({LINE_START_WORDS}){WS}"

PAGE_NUMBERS = (
    r"^\d+\z",
    rf"^-{WS}*\d+{WS}*-\z",
    rf"^\d+{WS}*/{WS}*\d+\z",
    rf"^\d+{WS}*-{WS}*\d+\z",
    r"^\[?\d+\]?\z",
    rf"^\d+{WS}*\z",
    rf"^(?i:Page|صفحة|ص){WS}*\d+\z",
    rf"^\d+{WS}*(?i:of|من){WS}*\d+\z",
)

HEADING_PAREN = rf"^\(\d+\){WS}"
HEADING_NUMBERED = rf"^\d+[.)–—]{WS}+"
HEADING_NUMBERED_ANY = rf"^\d+[.\-)–—]{WS}"
HEADING_EXAMPLE = rf"^(المثال){WS}+(الأول|الاول|الثاني|الثالث|الرابع|الخامس|السادس)"
HEADING_PARTICIPATION = rf"^(المشاركة){WS}+(الأولى|الأول|الثانية|الثاني|الثالثة|الثالث)"
#: Fixed value: units of a book, each with the numerals that may follow it.
HEADING_MAJOR = (
    "^(?:"
    rf"الفصل{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|الخامس|السادس|السابع|الثامن|التاسع|العاشر|[0-9]+)"
    rf"|الباب{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|الخامس|السادس|[0-9]+)"
    rf"|المبحث{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|الخامس|السادس|[0-9]+)"
    rf"|المطلب{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|الخامس|[0-9]+)"
    rf"|القسم{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|[0-9]+)"
    rf"|الجزء{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|[0-9]+)"
    rf"|الدرس{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|الخامس|السادس|[0-9]+)"
    rf"|الوحدة{WS}+(?:الأول|الاول|الثاني|الثالث|الرابع|الخامس|السادس|[0-9]+)"
    ")"
)
HEADING_SUB = rf"^(?:سورة{WS}|الحديث{WS}|الخاتمة|المقدمة|المراجع|المصادر|الملاحق|النتائج|التوصيات|ملخص|خلاصة|تمهيد|مدخل|ملحوظة|تنبيه|فائدة|تتمة|تكملة|هامش|أسئلة|تمارين|تدريبات|أهداف|مقدمة|خاتمة)"
HEADING_ORDINAL = rf"^(?:اولاً?|ثانياً?|ثالثاً?|رابعاً?|خامساً?|سادساً?|سابعاً?|ثامناً?|تاسعاً?|عاشراً?|أخيراً?|أخيرا){WS}*[.:]?{WS}+"

_DIGITS = r"[\d\x{0660}-\x{0669}\x{06F0}-\x{06F9}]"
EXAM_SCORES = (
    (rf"(?m)^(?:س{WS}*{_DIGITS}+|سؤال{WS}*{_DIGITS}*|س{WS}*[:：]|\({_DIGITS}+\){WS}*[:：]?)", 3),
    (rf"(?m)^(?:ج{WS}*[:：]|جواب{WS}*[:：]|الإجابة{WS}*[:：]|الجواب{WS}*[:：])", 2),
    (rf"(?m)^{WS}*[(\[]{WS}*[أابجدهوزحطيكلمنسعفصقرشت١٢٣٤٥٦٧٨٩\x{{0660}}-\x{{0669}}\x{{06F0}}-\x{{06F9}}0-9]{WS}*[)\]]", 2),
    (rf"\.{{3,}}|…{{2,}}|\[\.+\]|[(]{WS}*\.\.\.{WS}*[)]", 1),
    (r"[(][١٢٣٤\x{0660}-\x{0669}\x{06F0}-\x{06F9}-][)]|[(\[][أ-ي][)\]]", 2),
)
EXAM_QUESTION = rf"س{WS}*{_DIGITS}+"
EXAM_CUTOFF = 4

HTML_TAGS = (
    (rf"(?i)<br{WS}*/?>", "\n"),
    (r"(?i)</?u>", ""),
    (r"(?i)</?b>", ""),
    (r"(?i)</?i>", ""),
    (r"(?i)</?em>", ""),
    (r"(?i)</?strong>", ""),
    (r"(?i)</?span[^>]*>", ""),
    (r"(?i)</?div[^>]*>", ""),
    (r"(?i)</?p>", "\n"),
    (r"(?i)</?font[^>]*>", ""),
    (r"(?i)</?a[^>]*>", ""),
    (r"(?i)</?sup>", ""),
    (r"(?i)</?sub>", ""),
    (r"<[a-zA-Z][^>]{0,50}>", ""),
)
HTML_FRAGMENT = r"<[a-zA-Z][^>]{0,50}>"

#: A mark without which the pattern finds nothing (or none), the pattern, what it becomes; in this order.
PUNCTUATION = (
    (",", rf"({ARABIC}{WS}*),", "$1،"),
    (",", rf",{WS}*({ARABIC})", "، $1"),
    (";", rf"({ARABIC}{WS}*);", "$1؛"),
    (";", rf";{WS}*({ARABIC})", "؛ $1"),
    ("；", "；", "؛"),
    ("?", rf"({ARABIC}{WS}*)\?", "$1؟"),
    ("?", rf"\?{WS}*({ARABIC})", "؟ $1"),
    ("？", "？", "؟"),
    ("：", "：", ":"),
    ("（", "（", "("),
    ("）", "）", ")"),
    ("", "[«»‹›〈〉]", ""),
    ("", "[—ー‒]", "–"),
    ("", r"\.{3,}|[…⋯]+", "…"),
    ("،،", "،{2,}", "،"),
    ("؛؛", "؛{2,}", "؛"),
)

STOP_WORDS = (
    "في", "من", "إلى", "على", "مع", "هذا", "هذه", "ذلك", "تلك", "وقد", "كان", "كانت", "يكون", "هو", "هي", "他们", "نحن", "انت",
    "انها", "عن", "او", "اما", "ان", "لا", "ما", "لم", "لن", "به", "بها", "وب", "فى", "ثم", "حتى", "غير", "كل", "بعض", "هناك",
    "هنا", "عند", "بلغ", "عدد", "خلال", "بين", "ضمن",
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "have", "has", "was", "were", "been", "will", "would",
    "should", "can", "could", "may", "file", "document", "doc", "pdf", "page", "pages", "untitled", "copy",
)

SECRETS = (
    (r"AIza[0-9A-Za-z_-]{20,}", "<redacted-gcp-key>"),
    (r"AKIA[0-9A-Z]{16}", "<redacted-aws-key>"),
    (rf"(?i)Bearer{WS}+[A-Za-z0-9._-]+", "Bearer <redacted>"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "<redacted-jwt>"),
    (rf"(https?://){'[^/' + WS[1:]}+", "$1<redacted-host>"),
    (r"(?i)access[_-]?token[\"" + WS[1:-1] + r":=]+[A-Za-z0-9._-]+", "access_token=<redacted>"),
)

#: In order; the first that a message contains decides: (substrings, category, code).
FAILURES = (
    (("OCR_QUOTA_EXCEEDED",), "permanent", "OCR_QUOTA_EXCEEDED"),
    (("ALL_OCR_PROVIDERS_FAILED",), "permanent", "OCR_ENGINE_FAILED"),
    (("OCR_NO_TEXT",), "transient", "OCR_NO_TEXT"),
    (("PDF_ENCRYPTED",), "permanent", "PDF_ENCRYPTED"),
    (("PDF_CORRUPT",), "permanent", "PDF_CORRUPT"),
    (("PDF_TRUNCATED",), "permanent", "PDF_TRUNCATED"),
    (("PDF_INVALID", "PDF_MALFORMED"), "permanent", "PDF_INVALID"),
    (("PDF_EXCEEDS_MAX_PAGES",), "permanent", "PDF_EXCEEDS_MAX_PAGES"),
    (("PDF_RENDER_FAILED",), "permanent", "PDF_RENDER_FAILED"),
    (("FILE_TOO_LARGE",), "permanent", "FILE_TOO_LARGE"),
    (("INVALID_TYPE", "UNSUPPORTED_FORMAT"), "permanent", "INVALID_TYPE"),
    (("SURYA_EXECUTION_FAILED", "SURYA_TIMEOUT", "SURYA_NOT_AVAILABLE"), "permanent", "OCR_ENGINE_FAILED"),
    (("TESSERACT_FAILED",), "permanent", "OCR_ENGINE_FAILED"),
    (("PDF_SPLIT_EXECUTION_FAILED", "PDF_SPLIT_PARSE_FAILED"), "transient", "PDF_SPLIT_FAILED"),
    (("DIACRITICS_EXECUTION_FAILED",), "permanent", "OCR_ENGINE_FAILED"),
    (("OCR_EXPORT_FAILED",), "permanent", "OCR_ENGINE_FAILED"),
    (("EXPORT_PANDOC_MISSING", "EXPORT_FORMAT_FAILED"), "permanent", "EXPORT_GENERATION_FAILED"),
    (("EXPORT_STORAGE_FAILED",), "transient", "EXPORT_GENERATION_FAILED"),
    (("OCR_UPLOAD_FAILED",), "transient", "OCR_UPLOAD_FAILED"),
    (("ETIMEDOUT", "ECONNRESET", "socket hang up"), "transient", "NETWORK_ERROR"),
    (("RequestTimeout", "socket timeout", "UPLOAD_TIMEOUT"), "transient", "REQUEST_TIMEOUT"),
    (("rateLimit", "quota", "429"), "transient", "RATE_LIMITED"),
    (("Redis", "redis"), "transient", "REDIS_ERROR"),
    (("MinIO", "minio"), "transient", "STORAGE_ERROR"),
    (("STORAGE_ERROR", "STORAGE_UNAVAILABLE", "storage"), "transient", "STORAGE_ERROR"),
    (("DB_CONNECTION", "PrismaClient"), "transient", "DB_CONNECTION_FAILED"),
    (("SEARCH_INDEX_FAILED",), "transient", "SEARCH_INDEX_FAILED"),
    (("JOB_TIMEOUT",), "fatal", "JOB_TIMEOUT"),
    (("JOB_ABORTED",), "fatal", "JOB_ABORTED"),
)
OTHER_FAILURE = ("transient", "UNKNOWN_ERROR")

#: Quotations that may be verses, the marks and letters that tell, the brackets that always do; references to laws.
QUOTED = "[﴿«\"'(](.*?)[﴾»\"')]"
QUOTED_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭࣔ-࣡]"
QUOTED_LETTERS = "[؀-ۿ]"
VERSE_BRACKETS = ("﴿", "﴾")
MARKS_A_LETTER = 0.3
LAW = r"(?:المادة|قانون|مرسوم|قرار)\s*(?:رقم|عدد)?\s*\d+"
