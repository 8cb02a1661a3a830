"""Fixed values that results depend on: patterns, word lists, weights."""

# Letters unified before text is compared, each with its replacement.
LETTERS_FROM = "أإآىؤئة_"
LETTERS_TO = "ااايويه "
DIACRITICS = "[ً-ٰٟۖ-ۭ]"
TASHKEEL = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
TOKEN = "[A-Za-z0-9؀-ۿ]+"
# White space of a text, for a class of characters; \\s has that of ASCII only.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# What counts as a digit, for a class of characters: decimal digits of all scripts, and signs that stand for one digit.
DIGIT = r"\p{Nd}" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isdigit() and not c.isdecimal())
# Marks that citations are compared without.
MARKS = r"""[.,،؛:؟!()\[\]{}«»"'\-–—٪%/\\]"""
# Words that may stand between two parts of one quote.
CONNECTORS = "و|أو|ثم|في|من|إلى|على|عن|مع|بين|بل|لا|لم|هو|هي|أن|إن|كان|كما|حيث|لكن"
# Letters that tell the direction of a text.
RIGHT_TO_LEFT = "\u0590-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"

# Words left out of tokens.
STOP_WORDS = (
    "في من على الى إلى عن مع بين هذا هذه ذلك تلك وقد كما أن إن او أو ثم بعد قبل لدى لها لهم عند حول ضمن كان كانت يكون تكون تم قد "
    "the and for with from into that this"
).split()

# Lines that end the article, head a section, or are boilerplate.
PAGE_NUMBER = r"^\p{Nd}{1,4}$"
REFERENCE_TITLES = "المراجع|المصادر|قائمة المراجع|قائمة المصادر|المراجع والمصادر|المصادر والمراجع|قائمة المراجع والمصادر|References|Bibliography|Works Cited"
REFERENCE_HEADER = rf"^({REFERENCE_TITLES})\s*:?\s*$"
SECTION_TITLES = (
    "المقدمة|الخاتمة|المستخلص|الملخص|ملخص البحث|مشكلة البحث|أهداف البحث|أهمية البحث|فرضيات البحث|منهج البحث|منهجية البحث|حدود البحث|النتائج|نتائج البحث|المناقشة|"
    r"التوصيات|الإطار النظري|الدراسات السابقة|الفصل\s+.+|المبحث\s+.+|Abstract|Introduction|Methodology|Results|Discussion|Conclusion"
)
SECTION_HEADER = rf"^({SECTION_TITLES})\s*:?\s*$"
HEADING_LIKE = r"^.{5,60}:\s*$"
MONTHS = "يناير|فبراير|مارس|أبريل|مايو|يونيو|يوليو|أغسطس|سبتمبر|أكتوبر|نوفمبر|ديسمبر"
MONTHS_LATIN = "January|February|March|April|May|June|July|August|September|October|November|December"
BOILERPLATE = (
    r"^((مجلة|المجلة)\s.{5,80}|(العدد|المجلد)\s.{3,30}|ISSN\s*:?\s*[0-9\-]+|DOI\s*:?\s*\S+|جامعة\s.{3,50}\s*[-–]\s*كلية|Volume\s*[0-9]|Issue\s*[0-9]|Vol\.\s*[0-9]|"
    rf"({MONTHS})\s*[٠-٩0-9]{{4}}\s*م?|({MONTHS_LATIN})\s*[0-9]{{4}})$"
)
AUTHOR_LINE = (
    r"(^|\s)(أ\s*\.?\s*د|د\s*\.?|دكتور(ة)?\.?|أ\s*\.?\s*م|م\s*\.?\s*م|الدكتور|الدكتورة|الأستاذ|الاستاذ|الأستاذة|الاستاذة|Prof\.?|Dr\.?|By|بقلم|إعداد|اعداد)(\s|$)|"
    r"@|جامعة\s.+كلية|كلية\s.+قسم|قسم\s.+كلية|\.edu\.|\.ac\.|\.com$|\.org$"
)
AUTHOR_TITLE = (
    r"(^|\s)(أ\s*\.?\s*د|د\s*\.?|أ\s*\.?\s*م|م\s*\.?\s*م|الدكتور|الدكتوره|الدكتوراه|الأستاذ|الاستاذ|الأستاذه|الاستاذه|prof\.?|dr\.?|by|اعداد|إعداد|بقلم)(\s|$)|"
    r"جامعة\s.+كلية|كلية\s.+قسم|قسم\s.+كلية|@|\.edu\.|\.ac\.|\.org$|\.com$"
)

# Section labels by the terms they contain, first match first.
SECTION_BUCKETS = [
    ("abstract", ["المستخلص", "الملخص", "abstract"]),
    ("introduction", ["المقدمة", "مشكلة البحث", "أهداف البحث", "أهمية البحث", "introduction"]),
    ("theory", ["الإطار النظري", "الدراسات السابقة", "theory"]),
    ("methods", ["منهج", "منهجية", "الاداة", "العينه", "method"]),
    ("results", ["النتائج", "results"]),
    ("discussion", ["المناقشة", "discussion"]),
    ("conclusion", ["الخاتمة", "الاستنتاج", "conclusion"]),
    ("recommendations", ["التوصيات", "recommend"]),
]
BUCKET_ORDER = ["methods", "results", "discussion", "introduction", "theory", "conclusion", "recommendations", "abstract", "other"]

# Chunk sizes in characters.
CHUNK_TARGET, CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP = 1600, 400, 2400, 160
BUCKETS = 30_000
RRF_K = 60
