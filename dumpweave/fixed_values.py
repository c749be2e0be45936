"""Formats, limits and word lists that results depend on.

Each of these is part of the data formats or of the results to be matched, so
they are stated here in one place and never derived elsewhere.
"""

# --- file names of a split XML dump ---------------------------------------
# groups: 1 project, 2 dump date, 3 part number, 4 first page id, 5 last page id
DUMP_FILE_NAME = r"([^/]+)wiki-([^/]+)-pages-articles-multistream([^/]+)\.xml-p([^/]+)p([^/]+)\.bz2$"
# a file name with exactly the two suffixes .xml-p<first>p<last> and .bz2
VALID_DUMP_FILE = r"(^|/)[^/.]+\.xml-p[^/.]+p[^/.]+\.bz2$"

# --- SQL dumps ------------------------------------------------------------
INSERT_LINE = r"INSERT INTO (.*?) VALUES "
# columns by position in one tuple, first to last; only these are read
DUMP_COLUMNS = {
    "page": ["page_id", "namespace", "title", "restrictions", "is_redirect"],
    "link": ["pl_from", "namespace", "title", "from_namespace"],
    "categorylink": ["cl_from", "category"],
}

# --- limits ---------------------------------------------------------------
TITLE_LENGTH = 200  # characters, counted before transliteration
QUALITY_LENGTH = 2
PAGES_PER_FILE = 2000
EXPECTED_PAGES = 6_301_565
LEAD_TOKENS = 4100
SPECIAL_TOKENS = 2
LONGEST_WORD = 100  # characters of a word that is cut into pieces
TRAILING_CHUNKS = 7500

# --- quality grades, best first -------------------------------------------
GRADES = ["FA", "FL", "A", "GA", "B", "C"]
QUALITY_CLASS = r"^(.*?)-Class"

# --- titles and wikitext --------------------------------------------------
OTHER_NAMESPACE = r"^.+:.+$"
LEAD = "Lead"
# group 2 is the heading's own text
HEADING = r"(?md)^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t\r]*$"
# pairs of tags whose content is shown as it is written, and those that show nothing
VERBATIM_TAGS = ["nowiki", "pre", "source", "syntaxhighlight"]
INVISIBLE_TAGS = "categorytree gallery graph imagemap inputbox math score section templatestyles timeline".split()
TERM = r"[\p{L}\p{N}_]{2,}"
TOKEN = r"[\p{L}\p{N}_]+"

CONTINUATION = "##"  # before a vocabulary's pieces that go on within a word

# --- percentiles reported for lengths -------------------------------------
PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.99, 0.9999]

# --- English stop words, alphabetical -------------------------------------
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because
been before being below between both but by can't cannot could couldn't did
didn't do does doesn't doing don't down during each few for from further had
hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
it's its itself let's me more most mustn't my myself no nor not of off on once
only or other ought our ours ourselves out over own same shan't she she'd
she'll she's should shouldn't so some such than that that's the their theirs
them themselves then there there's these they they'd they'll they're they've
this those through to too under until up very was wasn't we we'd we'll we're
we've were weren't what what's when when's where where's which while who who's
whom why why's with won't would wouldn't you you'd you'll you're you've your
yours yourself yourselves
""".split()
# the recorded results were made with a list whose entry for "ours" ends in a
# comma, so the bare word was never removed
STOP_WORDS_AS_RECORDED = ["ours," if w == "ours" else w for w in STOP_WORDS]

# --- letters and marks without a Unicode decomposition, and their ASCII form
ASCII_FORMS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l",
    "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "–": "-", "—": "--", "‘": "'",
    "’": "'", "“": '"', "”": '"', "„": ",,", "…": "...", "×": "x", "¿": "?",
    "¡": "!", "«": "<<", "»": ">>",
}

# --- Greek and Cyrillic letters and their ASCII form; marked ones decompose first
_GREEK = "αa βb γg δd εe ζz ηe θth ιi κk λl μm νn ξx οo πp ρr ςs σs τt υu φph χkh ψps ωo"
_CYRILLIC = (
    "аa бb вv гg дd еe жzh зz иi йi кk лl мm нn оo пp рr сs тt уu фf хkh цts чch шsh щshch ъ\" ыy ь' эe юiu яia "
    "ѐie ёio ђdj ѓgj єie ѕdz іi їyi јj љlj њnj ћtsh ќkj ѝi ўu џdzh ґg"
)
SCRIPT_FORMS = {x[0]: x[1:] for x in f"{_GREEK} {_CYRILLIC}".split()}
SCRIPT_FORMS |= {c.upper(): form.capitalize() for c, form in SCRIPT_FORMS.items() if c != "ς"}
SCRIPT_FORMS |= {"Ξ": "Ks", "Ъ": "'"}
