"""Vocabularies, thresholds, patterns and lookup tables.

Everything here is data that results depend on (word lists, mapping tables,
rubric constants, regular expressions). It is stated once, in natural order,
and imported by the operators; no logic lives in this module.
"""

from __future__ import annotations

# ---------------------------------------------------------------- rubric ----
COMPONENTS = ("academic", "cost", "fit", "culture", "activities", "personality")
DEFAULT_WEIGHTS = {
    "academic": 0.28,
    "cost": 0.18,
    "fit": 0.18,
    "culture": 0.18,
    "activities": 0.10,
    "personality": 0.08,
}
CULTURE_AXES = ("collab", "quirky", "idealist", "research", "spirit", "seminar")
PERSONALITY_AXES = ("intensity", "scale")
GPA_SIGMA = 0.35
SAT_SIGMA = 130.0
OVERMATCH_BONUS = 0.08
OVERMATCH_BONUS_CAP = 0.5
REFERENCE_PRICE = 60000.0
MAJOR_MISS = 0.3
SCALE_TOP = 25000.0
ADMIT_TIER_DELTA = 0.12
EXTREME_REACH_RATE = 0.15
CONFIDENCE_STOP = 0.9
FEEDBACK_MIN, FEEDBACK_MAX = 0.5, 1.5
DEFAULT_RATIONALE = "Top-ranked match for this profile."

# Activity text pattern -> subjects a school may be strong in, in rule order.
ACTIVITY_SUBJECTS = (
    (r"robot|hackathon|coding|code|program|software|cyber|game dev|app",
     ("Computer Science", "Engineering", "Data Science", "Cybersecurity")),
    (r"science fair|olympiad|research|\blab\b|biology|chemistry|physics",
     ("Biology", "Chemistry", "Physics", "Neuroscience", "Research")),
    (r"math|calculus|number theory|putnam",
     ("Mathematics", "Math", "Statistics", "Data Science")),
    (r"debate|model un|\bmun\b|mock trial|speech|policy",
     ("Political Science", "International Relations", "Public Policy", "Law", "Philosophy")),
    (r"business|deca|entrepreneur|startup|invest|finance|marketing",
     ("Business", "Economics", "Finance", "Marketing", "Management")),
    (r"volunteer|service|nonprofit|charity|tutor|mentor|community",
     ("Social Work", "Public Health", "Education", "Sociology")),
    (r"music|band|orchestra|choir|jazz|piano|violin|composition",
     ("Music", "Music Performance", "Composition", "Performance")),
    (r"art|paint|draw|photograph|sculpt|design|ceramics",
     ("Studio Art", "Art", "Design", "Fine Arts", "Architecture")),
    (r"theat|drama|acting|film|dance|cinema",
     ("Drama", "Theatre", "Film", "Performance")),
    (r"writ|journal|newspaper|poetry|literary|yearbook",
     ("English", "Journalism", "Creative Writing", "Communications")),
    (r"environment|sustain|climate|ecology|conservation",
     ("Environmental Science", "Environmental Studies", "Geology")),
    (r"hospital|medic|nurs|pre-med|health|dental|pharma",
     ("Nursing", "Public Health", "Biology", "Health Sciences", "Medicine")),
    (r"engineer|build|maker|3d print|\bcad\b|rocket|car",
     ("Engineering", "Mechanical Engineering", "Electrical Engineering", "Architecture")),
    (r"sport|athlet|varsity|soccer|basketball|swim|track|tennis",
     ("Kinesiology", "Sport Management", "Health Sciences")),
)

# ------------------------------------------------------------ catalog build --
MISSING_CELLS = ("", "NA", "NULL", "PrivacySuppressed")
SMALL_MAX, MEDIUM_MAX = 5000, 15000
MIN_SAFE_ROWS = 100
CIP_FAMILIES = {
    "PCIP01": "Agriculture",
    "PCIP03": "Natural Resources & Conservation",
    "PCIP04": "Architecture",
    "PCIP05": "Area, Ethnic & Gender Studies",
    "PCIP09": "Communication & Journalism",
    "PCIP10": "Communications Technologies",
    "PCIP11": "Computer & Information Sciences",
    "PCIP12": "Personal & Culinary Services",
    "PCIP13": "Education",
    "PCIP14": "Engineering",
    "PCIP15": "Engineering Technologies",
    "PCIP16": "Foreign Languages & Linguistics",
    "PCIP19": "Family & Consumer Sciences",
    "PCIP22": "Legal Studies",
    "PCIP23": "English Language & Literature",
    "PCIP24": "Liberal Arts & Humanities",
    "PCIP25": "Library Science",
    "PCIP26": "Biological & Biomedical Sciences",
    "PCIP27": "Mathematics & Statistics",
    "PCIP29": "Military Technologies",
    "PCIP30": "Interdisciplinary Studies",
    "PCIP31": "Parks, Recreation & Fitness",
    "PCIP38": "Philosophy & Religious Studies",
    "PCIP39": "Theology & Religious Vocations",
    "PCIP40": "Physical Sciences",
    "PCIP41": "Science Technologies",
    "PCIP42": "Psychology",
    "PCIP43": "Homeland Security & Law Enforcement",
    "PCIP44": "Public Administration & Social Service",
    "PCIP45": "Social Sciences",
    "PCIP46": "Construction Trades",
    "PCIP47": "Mechanic & Repair Technologies",
    "PCIP48": "Precision Production",
    "PCIP49": "Transportation & Materials Moving",
    "PCIP50": "Visual & Performing Arts",
    "PCIP51": "Health Professions",
    "PCIP52": "Business, Management & Marketing",
    "PCIP54": "History",
}
OUTCOME_COLUMNS = {
    "graduation_rate": "C150_4",
    "median_earnings_10yr": "MD_EARN_WNE_P10",
    "median_earnings_6yr": "MD_EARN_WNE_P6",
    "median_debt": "GRAD_DEBT_MDN",
    "pct_pell": "PCTPELL",
    "pct_federal_loans": "PCTFLOAN",
}
POPULATION_COLUMNS = {
    "international_share": "UGDS_NRA",
    "women_share": "UGDS_WOMEN",
    "first_gen_share": "FIRST_GEN",
}
SCORECARD_COLUMNS = (
    "UNITID", "INSTNM", "CITY", "STABBR", "ADM_RATE", "SAT_AVG", "UGDS",
    "NPT4_PUB", "NPT4_PRIV", "TUITIONFEE_OUT", "TUITIONFEE_IN",
    *OUTCOME_COLUMNS.values(), *POPULATION_COLUMNS.values(),
    "INSTURL", "NPCURL", *CIP_FAMILIES,
)
DETAIL_PROVENANCE = {
    "curated": "observed",
    "web_verified": "web_verified",
    "estimated": "editorial",
}
EXCLUDED_INSTITUTIONS = (
    "Mills College at Northeastern",
    "Cornish College of the Arts",
    "Boston Conservatory at Berklee",
)
EMPTY_MARKERS = (
    "", "n/a", "na", "none", "none found", "not found", "unknown", "tbd", "null",
)
MERGEABLE_SECTIONS = ("faculty", "research")

# ------------------------------------------------------------ school filter --
US_COUNTRY_VALUES = ("USA", "US", "UNITED STATES", "UNITED STATES OF AMERICA")
US_STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)
CITY_STATE_PATTERN = r"^(.*),\s*([A-Za-z]{2})\s*$"
COMPOUND_SUFFIXES = (
    "ac.uk", "ac.jp", "ac.nz", "ac.za", "ac.kr", "ac.in", "edu.au", "edu.cn",
    "edu.sg", "edu.hk", "edu.mx", "edu.br", "co.uk", "com.au",
)

#: Public-suffix rules: `*.` stands for any one label, `!` excepts a name from such a rule.
SUFFIX_RULES = (
    "com", "edu", "gov", "net", "org", "ac", "ac.at", "ac.be", "ac.cn", "ac.cr", "ac.cy", "ac.id", "ac.il", "ac.in",
    "ac.ir", "ac.jp", "ac.ke", "ac.kr", "ac.lk", "ac.ma", "ac.nz", "ac.rs", "ac.th", "ac.tz", "ac.ug", "ac.uk", "ac.za",
    "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.hk", "com.mx",
    "com.pl", "com.sg", "com.tr", "com.tw", "edu.ar", "edu.au", "edu.bd", "edu.br", "edu.cn", "edu.co", "edu.ec",
    "edu.eg", "edu.gh", "edu.gr", "edu.hk", "edu.it", "edu.jo", "edu.lb", "edu.mt", "edu.mx", "edu.my", "edu.ng",
    "edu.pe", "edu.ph", "edu.pk", "edu.pl", "edu.qa", "edu.ro", "edu.rs", "edu.ru", "edu.sa", "edu.sg", "edu.tr",
    "edu.tw", "edu.ua", "edu.uy", "edu.vn", "gov.uk", "org.au", "org.uk", "*.ck", "!www.ck", "*.kobe.jp",
    "!city.kobe.jp", "*.bd", "*.np",
)

# -------------------------------------------------------- directory walking --
PROFILE_PATTERNS = ("/faculty/", "/people/", "/profile", "?id=", "/directory/")
ASSET_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".tif", ".tiff",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".gz", ".tar",
    ".mp3", ".mp4", ".mov", ".avi", ".css", ".js", ".rss", ".xml",
)
ASSET_PATH_HINTS = ("/files/", "/uploads/", "/assets/", "/static/", "_image", "/media/")
PAGINATION_QUERY_KEYS = ("page", "p", "pg", "letter", "ltr", "start", "offset")
PAGINATION_TEXT = r"(?i)^(next|previous|prev|first|last|»|«|›|‹|>|<|[a-z]|\d{1,4})$"
PAGINATION_PATH = r"(?i)/page/\d+/?$"
IGNORED_SCHEMES = ("javascript:", "mailto:", "tel:")
HEURISTIC_PATHS = (
    "/faculty", "/people", "/directory", "/academics/faculty", "/faculty-staff",
    "/staff-directory",
)
DEPARTMENT_INDEX_PATHS = (
    "/academics", "/academics/departments", "/departments", "/schools-and-departments",
    "/colleges-and-schools",
)
DEPARTMENT_LINK_HINTS = ("department", "academics", "school-of", "college-of", "program")
PEOPLE_LINK_HINTS = ("faculty", "people", "directory", "staff", "our-team", "instructors")
DIRECTORY_HINTS = ("faculty", "people", "directory", "staff")
INDEX_BASENAMES = ("", "index.html", "index.htm", "index.php", "index.asp", "index.aspx")
MIN_CLUSTER_SIZE = 5
SOFT_404_MARKERS = (
    "page not found", "404 not found", "404 error", "we couldn't find",
    "we could not find", "cannot be found", "could not be found", "doesn't exist",
    "does not exist", "sorry, this page", "sorry, we couldn't",
)
CLUSTER_ONLY_CONFIDENCE = 0.9
MAX_DIRECTORY_PAGES = 20
MAX_PROFILES_PER_SCHOOL = 100
MAX_DEPARTMENTS_PER_SCHOOL = 8
MAX_SITEMAP_DOCUMENTS = 25
MAX_SITEMAP_URLS = 50000
MAX_CATEGORY_MEMBERS = 1500
EXCERPT_MAX_CHARS = 4000

# --------------------------------------------------------------- extraction --
NOISE_TAGS = ("script", "style", "noscript", "svg", "nav", "footer", "header")
EMAIL_PATTERN = r"[\w.+\-]+@[\w-]+(?:\.[\w-]+)+"
PHONE_PATTERN = (
    r"(?i)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?:\s*(?:x|ext\.?)\s*\d{1,6})?"
)
BRACKET_AT = r"(?i)\s*[\[(]\s*at\s*[\])]\s*"
BRACKET_DOT = r"(?i)\s*[\[(]\s*dot\s*[\])]\s*"
BARE_AT = r"(?<=[\w.])\s+AT\s+(?=[\w.])"
BARE_DOT = r"(?<=[\w])\s+DOT\s+(?=[\w])"
BOILERPLATE_SEPARATORS = (" | ", " - ", " – ", " — ", " :: ", ": ")
NO_MODEL_CONFIDENCE = 0.5
ACADEMIC_TITLE = (
    r"\b(professor|prof\.|lecturer|instructor|faculty|preceptor|"
    r"artist[- ]in[- ]residence|writer[- ]in[- ]residence|scholar[- ]in[- ]residence|"
    r"postdoc(?:toral)?|research (?:scientist|professor)|teaching (?:fellow|associate))\b"
)
ADMIN_TITLE = (
    r"\b(president|provost|chancellor|registrar|bursar|treasurer|trustee|"
    r"chief \w+ officer|vice[- ]chancellor|"
    r"director of (?:admissions?|communications?|marketing|development|advancement|"
    r"human resources|finance|operations|athletics|facilities|alumni relations)|"
    r"(?:head |assistant |associate )?coach|administrative (?:assistant|coordinator)|"
    r"admissions (?:counselor|officer)|human resources|"
    r"board (?:of trustees|chair|member)|member, board|"
    r"alumn(?:us|a|i|ae)|philanthropist|chief|founder|executive director|"
    r"(?:design |managing )?principal, )\b"
)

# ------------------------------------------------------------------- export --
MIN_CONFIDENCE = 0.5
STALE_SHARE = 0.15
PARTIAL_MIN_PROFILES = 8
PARTIAL_CONCENTRATION = 0.9
PROFESSOR_COLUMNS = (
    "school_id", "school_name", "professor_name", "title", "is_faculty", "department",
    "email", "phone", "research_interests", "profile_url", "directory_url",
    "extraction_confidence", "extracted_at",
)

# --------------------------------------------------------------- enrichment --
RECENT_YEARS = 3
TOP_PEOPLE = 20
AUTHOR_POOL = 60
NON_PERSON_PREFIXES = ("List of", "Category:", "Template:", "Portal:", "Draft:", "File:")
UNINFORMATIVE_OCCUPATIONS = ("researcher", "university teacher", "academic", "scientist")
HUMAN_QID = "Q5"
FIELD_TO_FAMILIES = {
    "Physics and Astronomy": ("Physical Sciences", "Engineering"),
    "Chemistry": ("Physical Sciences", "Engineering"),
    "Earth and Planetary Sciences": ("Physical Sciences", "Natural Resources & Conservation"),
    "Environmental Science": ("Natural Resources & Conservation", "Physical Sciences"),
    "Mathematics": ("Mathematics & Statistics", "Computer & Information Sciences"),
    "Computer Science": ("Computer & Information Sciences", "Engineering"),
    "Engineering": ("Engineering", "Engineering Technologies", "Architecture"),
    "Materials Science": ("Engineering", "Physical Sciences"),
    "Chemical Engineering": ("Engineering",),
    "Energy": ("Engineering", "Physical Sciences"),
    "Biochemistry, Genetics and Molecular Biology": ("Biological & Biomedical Sciences",),
    "Agricultural and Biological Sciences": (
        "Agriculture", "Biological & Biomedical Sciences", "Natural Resources & Conservation"),
    "Immunology and Microbiology": ("Biological & Biomedical Sciences", "Health Professions"),
    "Neuroscience": ("Biological & Biomedical Sciences", "Psychology", "Health Professions"),
    "Medicine": ("Health Professions", "Biological & Biomedical Sciences"),
    "Nursing": ("Health Professions",),
    "Dentistry": ("Health Professions",),
    "Veterinary": ("Health Professions", "Agriculture"),
    "Health Professions": ("Health Professions",),
    "Pharmacology, Toxicology and Pharmaceutics": (
        "Health Professions", "Biological & Biomedical Sciences"),
    "Psychology": ("Psychology", "Social Sciences"),
    "Social Sciences": (
        "Social Sciences", "Public Administration & Social Service",
        "Area, Ethnic & Gender Studies", "Education", "Legal Studies"),
    "Economics, Econometrics and Finance": ("Social Sciences", "Business, Management & Marketing"),
    "Business, Management and Accounting": ("Business, Management & Marketing",),
    "Decision Sciences": ("Business, Management & Marketing", "Mathematics & Statistics"),
    "Arts and Humanities": (
        "Visual & Performing Arts", "English Language & Literature", "History",
        "Philosophy & Religious Studies", "Foreign Languages & Linguistics",
        "Liberal Arts & Humanities", "Communication & Journalism", "Architecture",
        "Theology & Religious Vocations"),
}
NOTABLE_FIELDS = (
    "name", "known_for", "fields", "status", "prominence", "awards", "source", "source_url",
)
ACTIVE_FIELDS = (
    "name", "research", "fields", "recent_works", "last_active", "h_index", "awards",
    "source", "source_url",
)

# ------------------------------------------------------------- list balance --
SAFETY_MIN, SAFETY_MAX = 0.15, 0.2
MAX_SUGGESTIONS = 3
TIER_LABELS = {
    "extreme_reach": "Extreme reach",
    "reach": "Reach",
    "target": "Target",
    "safety": "Safety",
}
PROVENANCE_NOTES = {"editorial": "est.", "web_verified": "verified"}
COMPARE_ROWS = (
    ("Avg GPA", "avg_gpa", "decimal"),
    ("Avg SAT", "avg_sat", "score"),
    ("Acceptance", "acceptance_rate", "percent"),
    ("Net price", "net_price", "money"),
    ("Undergrads", "enrollment", "number"),
)

# ------------------------------------------------------------- major finder --
W_COURSES, W_ACTIVITIES, W_AXES = 0.45, 0.20, 0.35
AXIS_REASON_MIN = 0.85
QUESTIONS = (
    "collab", "quirky", "idealist", "research", "spirit", "seminar", "intensity", "scale",
)
# name, courses, (people, applied, creative), activity pattern, CIP family
MAJORS = (
    ("Computer Science", ("Computer Science", "Math", "Physics"), (0.2, 0.6, 0.45),
     "code|program|robot|hack|app|software|cyber|game", "Computer & Information Sciences"),
    ("Data Science / Statistics", ("Statistics", "Math", "Computer Science"), (0.25, 0.55, 0.4),
     "data|statist|analytic|machine learning|code", "Mathematics & Statistics"),
    ("Mechanical / General Engineering", ("Math", "Physics", "Engineering / Tech"),
     (0.3, 0.85, 0.5), "engineer|build|robot|maker|cad|car|rocket", "Engineering"),
    ("Electrical & Computer Engineering",
     ("Math", "Physics", "Computer Science", "Engineering / Tech"),
     (0.25, 0.75, 0.45), "circuit|electron|robot|code|hardware|engineer", "Engineering"),
    ("Biomedical Engineering", ("Biology", "Math", "Physics", "Engineering / Tech"),
     (0.4, 0.75, 0.5), "bio|medic|device|engineer|lab|research", "Engineering"),
    ("Biology", ("Biology", "Chemistry", "Math", "Health / Anatomy"), (0.4, 0.5, 0.35),
     "bio|lab|research|medic|hospital|health|environment", "Biological & Biomedical Sciences"),
    ("Chemistry", ("Chemistry", "Math", "Physics", "Biology"), (0.25, 0.55, 0.4),
     "chem|lab|research|material", "Physical Sciences"),
    ("Physics", ("Physics", "Math", "Computer Science"), (0.2, 0.4, 0.45),
     "physic|astro|research|olympiad|quantum", "Physical Sciences"),
    ("Mathematics", ("Math", "Statistics", "Computer Science"), (0.2, 0.4, 0.4),
     "math|olympiad|proof|puzzle|code", "Mathematics & Statistics"),
    ("Neuroscience", ("Biology", "Chemistry", "Psychology", "Health / Anatomy"),
     (0.45, 0.5, 0.4), "neuro|brain|bio|research|psych|medic",
     "Biological & Biomedical Sciences"),
    ("Nursing", ("Biology", "Chemistry", "Health / Anatomy", "Psychology"), (0.85, 0.85, 0.3),
     "nurs|health|hospital|medic|care|volunteer", "Health Professions"),
    ("Public Health", ("Biology", "Statistics", "Health / Anatomy", "Psychology"),
     (0.75, 0.55, 0.35), "health|public|epidem|community|policy|volunteer",
     "Health Professions"),
    ("Psychology", ("Psychology", "Biology", "Statistics"), (0.85, 0.5, 0.4),
     "psych|counsel|mental|research|volunteer|people", "Psychology"),
    ("Economics", ("Economics", "Math", "Statistics", "Government / Politics"),
     (0.5, 0.5, 0.35), "econ|invest|business|policy|debate|stock|research", "Social Sciences"),
    ("Business / Management", ("Business", "Economics", "Math"), (0.75, 0.7, 0.4),
     "business|startup|entrepreneur|market|deca|invest|manage",
     "Business, Management & Marketing"),
    ("Finance / Accounting", ("Business", "Economics", "Math", "Statistics"),
     (0.55, 0.65, 0.25), "finance|account|invest|stock|business|audit",
     "Business, Management & Marketing"),
    ("Marketing / Communications", ("Business", "English / Literature", "Psychology"),
     (0.8, 0.7, 0.7), "market|communic|social media|advertis|brand|pr|writ",
     "Business, Management & Marketing"),
    ("Political Science", ("Government / Politics", "History", "English / Literature"),
     (0.7, 0.4, 0.4), "politic|debate|model un|mun|government|policy|campaign|law",
     "Social Sciences"),
    ("International Relations",
     ("Government / Politics", "History", "Foreign Language", "Economics"), (0.7, 0.4, 0.4),
     "international|diplomacy|model un|mun|global|policy|language", "Social Sciences"),
    ("English / Literature", ("English / Literature", "History", "Foreign Language"),
     (0.55, 0.35, 0.85), "writ|read|literary|poetry|journal|book|debate",
     "English Language & Literature"),
    ("History", ("History", "English / Literature", "Government / Politics"),
     (0.45, 0.3, 0.55), "histor|research|debate|writ|museum|archive", "History"),
    ("Philosophy", ("English / Literature", "Math", "History"), (0.4, 0.2, 0.6),
     "philosoph|debate|ethics|logic|argument|writ", "Philosophy & Religious Studies"),
    ("Sociology / Social Work", ("Psychology", "Government / Politics", "Statistics"),
     (0.9, 0.55, 0.4), "social|community|volunteer|nonprofit|advoca|justice|care",
     "Social Sciences"),
    ("Education", ("English / Literature", "Psychology", "History"), (0.9, 0.75, 0.55),
     "teach|tutor|education|coach|mentor|kids", "Education"),
    ("Art & Design", ("Art",), (0.4, 0.7, 0.95),
     "art|paint|draw|design|photograph|graphic|illustrat", "Visual & Performing Arts"),
    ("Music", ("Music",), (0.5, 0.75, 0.95),
     "music|band|orchestra|choir|jazz|instrument|compos|produc", "Visual & Performing Arts"),
    ("Film / Theatre", ("Art", "English / Literature", "Music"), (0.7, 0.75, 0.95),
     "film|theat|drama|acting|cinema|dance|video", "Visual & Performing Arts"),
    ("Architecture", ("Art", "Math", "Physics"), (0.5, 0.85, 0.85),
     "architect|design|build|draw|cad|urban", "Architecture"),
    ("Environmental Science", ("Environmental Science", "Biology", "Chemistry"),
     (0.45, 0.6, 0.35), "environment|sustain|climate|ecology|outdoors|conservation",
     "Natural Resources & Conservation"),
)

# --------------------------------------------------------------- validation --
REGIONS = ("Northeast", "South", "West", "Midwest", "International")
SETTINGS = ("urban", "suburban", "rural")
INSTITUTION_TYPES = ("Public", "Private")
SIZES = ("small", "medium", "large")
SCOPES = ("usa", "international", "both")
