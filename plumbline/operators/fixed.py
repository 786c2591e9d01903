"""Word lists, patterns, weights and limits that results depend on. They are data, not logic."""

#: The order of features in a vector, and the largest shift of each at severity 1.
FEATURES = (
    "email_free_provider", "email_absent", "email_domain_mismatch", "contact_messaging_only", "qualification_conflict", "url_shortener",
    "salary_implausible_vs_umk", "risk_phrase_score_id", "payment_request_id",
)
WEIGHTS = {
    "payment_request_id": 0.10, "contact_messaging_only": 0.08, "salary_implausible_vs_umk": 0.07, "risk_phrase_score_id": 0.06, "email_free_provider": 0.04,
    "email_domain_mismatch": 0.04, "url_shortener": 0.03, "qualification_conflict": 0.02, "email_absent": 0.01,
}
#: Points per feature where no weights are given.
PLACEHOLDER_POINTS = {
    "email_free_provider": 12.0, "email_absent": 8.0, "email_domain_mismatch": 14.0, "contact_messaging_only": 16.0, "url_shortener": 10.0,
    "qualification_conflict": 12.0, "salary_implausible_vs_umk": 15.0, "risk_phrase_score_id": 15.0, "payment_request_id": 18.0,
}
MAX_WEIGHT, MAX_SHIFT = 0.10, 0.45

#: Mail providers by registrable label, hosts by class, and what chat hand-overs say.
FREE_PROVIDERS = (
    "gmail", "googlemail", "yahoo", "ymail", "rocketmail", "hotmail", "outlook", "live", "msn", "aol", "icloud", "me", "mac", "gmx", "yandex", "mail",
    "zoho", "protonmail", "proton", "tutanota", "inbox", "hushmail", "fastmail",
)
DISPOSABLE_PROVIDERS = (
    "mailinator", "guerrillamail", "10minutemail", "tempmail", "temp-mail", "throwawaymail", "yopmail", "trashmail", "sharklasers", "getnada",
    "maildrop", "dispostable", "fakeinbox", "mohmal",
)
SHORTENERS = (
    "bit.ly", "bitly.com", "tinyurl.com", "s.id", "cutt.ly", "ow.ly", "t.co", "goo.gl", "rebrand.ly", "is.gd", "buff.ly", "shorturl.at", "rb.gy",
    "gg.gg", "bit.do", "adf.ly", "shorte.st", "tiny.cc", "v.gd", "urlz.fr",
)
AGGREGATORS = ("linktr.ee", "linktree.com", "lynk.id", "bio.link")
WHATSAPP_HOSTS = ("wa.me", "api.whatsapp.com", "chat.whatsapp.com", "whatsapp.com")
TELEGRAM_HOSTS = ("t.me", "telegram.me", "telegram.dog", "telegram.org")
WHATSAPP_PHRASES = ("hubungi via whatsapp", "hubungi via wa", "chat wa", "wa ke", "whatsapp ke", "hubungi wa", "langsung wa", "japri wa", "chat langsung ke wa")
TELEGRAM_PHRASES = (
    "via telegram", "interview via telegram", "hubungi telegram", "daftar via telegram", "gabung telegram", "chat telegram", "wawancara via telegram", "telegram admin",
)
CHAT_HIRING = ("interview via chat", "wawancara via chat", "interview online via", "langsung kerja tanpa interview", "tanpa interview", "diterima tanpa wawancara")
ANONYMOUS = ("hubungi admin", "chat admin", "hubungi kak", "hubungi bapak/ibu")

#: What says that no experience is asked for, and how many years are; years below MIN_YEARS don't conflict.
NO_EXPERIENCE = (
    "tanpa pengalaman", "tidak perlu pengalaman", "tidak memerlukan pengalaman", "pengalaman tidak diutamakan", "fresh graduate", "fresh grad", "lulusan baru",
    "belum berpengalaman", "pemula",
    "no experience", "no prior experience", "without experience", "experience not required", "entry level", "entry-level", "no experience necessary",
)
NEGATION = r"(?U)\b(bukan|tidak|not|non)\s*$"
YEARS = (
    r"(?iU)pengalaman\s*(?:kerja\s*)?(?:minimal|min\.?|minimum|min)?\s*(\d{1,2})\s*(?:\+\s*)?tahun"
    r"|(\d{1,2})\s*(?:\+\s*)?tahun\s*pengalaman"
    r"|(?:minimum|minimal|at\s+least|min\.?)\s*(\d{1,2})\s*(?:\+\s*)?years?"
    r"|(\d{1,2})\s*(?:\+\s*)?years?\s*(?:of\s*)?(?:relevant\s*|prior\s*|work\s*)?experience"
)
MIN_YEARS, NEGATION_WINDOW = 2, 40

#: Words near a salary and near a cost, periods after an amount, units, and how far context reaches.
SALARY_WORDS = (
    r"(?iU)\b(gaji|salary|upah|penghasilan|pendapatan|honor|thp|take home pay|income|bayaran|imbalan|fee|pay|wage|compensation|earn|earning|earnings|"
    r"stipend|remuneration)\b"
)
COST_WORDS = r"(?iU)\b(biaya|bayar|transfer|deposit|jaminan|denda|potongan|iuran|cost|charge|fee\s+of|payment\s+of|pay\s+us|refundable)\b"
PER_HOUR = r"(?iU)/\s*(?:jam|h|hr|hour)\b|per\s+(?:jam|hour)|sejam|hourly"
PER_DAY = r"(?iU)/\s*(?:hari|day)|per\s+(?:hari|day)|sehari|harian|daily"
PER_WEEK = r"(?iU)/\s*(?:minggu|week|wk)\b|per\s+(?:minggu|week)|mingguan|weekly"
PER_YEAR = r"(?iU)/\s*(?:tahun|year|yr|annum)\b|per\s+(?:tahun|year|annum)\b|\b(?:tahunan|annually|annual|pa|p\.a\.)\b"
HOURS, DAYS, WEEKS, MONTHS = 173.33, 22, 4, 12
UNITS = {"million": 1e6, "juta": 1e6, "ribu": 1e3, "jt": 1e6, "rb": 1e3, "mn": 1e6, "k": 1e3, "m": 1e6}
SALARY_WINDOW, SALARY_TAIL = 60, 25
ENTRY_MULTIPLE, GENERAL_MULTIPLE = 2.5, 6.0

#: Severities of the contact rules.
DISPOSABLE, FREE, MISMATCH = 0.95, 0.55, 0.60
NO_ADDRESS, NO_ROUTE = 0.35, 0.55
TELEGRAM, WHATSAPP, CHAT_BOOST, ANONYMOUS_BOOST = 0.75, 0.35, 0.15, 0.10
SHORT_AND_OTHER, SHORT_ONLY = 0.45, 0.65

#: How far the context of a phrase reaches, the words that turn a demand into a benefit, and what ends a clause.
BENEFIT_WINDOW = 45
BENEFIT_BEFORE = (
    r"ditanggung", r"menanggung", r"tanggung", r"digratiskan", r"gratis", r"bebas", r"tanpa", r"tidak\s+ada", r"tidak\s+dipungut", r"tidak\s+memungut", r"disediakan",
    r"diberikan", r"difasilitasi", r"dibayarkan\s+perusahaan", r"perusahaan\s+menanggung", r"kami\s+menanggung",
    r"no", r"never", r"without", r"free", r"complimentary", r"waived", r"no\s+charge", r"free\s+of", r"at\s+no\s+cost", r"we\s+cover", r"we\s+pay", r"company\s+covers",
    r"company\s+pays", r"employer\s+pays", r"fully\s+funded", r"covered\s+by", r"paid\s+by\s+(?:the\s+)?company", r"reimbursed", r"we\s+provide", r"there\s+is\s+no",
    r"there's\s+no", r"you\s+will\s+never\s+be\s+asked",
)
BENEFIT_AFTER = (
    r"(?:sepenuhnya\s+)?(?:akan\s+)?(?:ditanggung|digratiskan|gratis|dibayarkan|disediakan|ditiadakan)",
    r"(?:is\s+|are\s+|will\s+be\s+)?(?:waived|covered|reimbursed|paid\s+by\s+(?:the\s+)?(?:company|employer))",
)
CLAUSE_WORDS = (r"namun", r"tetapi", r"tapi", r"akan\s+tetapi", r"melainkan", r"hanya\s+saja", r"but", r"however")

#: Fixed values by locale: words that mark its language, and what the salary rule needs to know.
LOCALES = {
    "en": {
        "markers": (
            " the ", " and ", " with ", " for ", " you ", " your ", " we ", " our ", " will ", " must ", " have ", " this ", " that ", " are ", " is ",
            "experience", "requirements", "responsibilities", "salary", "apply",
        ),
        "entry": (
            "no experience", "no prior experience", "entry level", "entry-level", "fresh graduate", "no experience necessary", "no experience required", "beginners welcome",
            "will train", "training provided", "any age", "high school", "students welcome", "no skills",
        ),
        "senior": (
            "manager", "supervisor", "director", "head of", "senior", "lead ", "principal", "specialist", "engineer", "developer", "architect", "analyst", "consultant",
            "years of experience", "phd", "master's",
        ),
        "roles": (
            "data entry", "clerk", "administrative assistant", "packer", "courier", "typist", "receptionist", "cashier", "customer service", "warehouse", "sales assistant",
            "helper", "operator", "assistant",
        ),
        "currency": ("$", "usd", "us$", "£", "gbp", "€", "eur"), "dot_is_thousands": False, "floor": 100, "ceiling": 100_000,
    },
    "id": {
        "markers": (
            " yang ", " dan ", " untuk ", " dengan ", " dari ", " akan ", " tidak ", " kami ", " anda ", " di ", " ke ", " atau ", " pada ",
            "lowongan", "pengalaman", "kualifikasi", "gaji", "lamaran", "perusahaan", "dibutuhkan", "pelamar", "kerja",
        ),
        "entry": (
            "tanpa pengalaman", "tidak perlu pengalaman", "fresh graduate", "fresh grad", "lulusan baru", "pemula", "semua umur", "minimal sma", "min sma", "min smp",
            "lulusan sma", "tidak ada syarat", "tanpa skill", "pelajar", "mahasiswa", "tanpa pengalaman kerja",
        ),
        "senior": (
            "manager", "manajer", "supervisor", "kepala", "direktur", "senior", "spesialis", "engineer", "developer", "programmer", "analis", "konsultan", "dokter", "apoteker",
            "arsitek", "akuntan", "auditor", "pengalaman minimal", "pengalaman min", "tahun pengalaman", "s2", "magister",
        ),
        "roles": (
            "admin online", "admin olshop", "data entry", "packing", "kurir", "pengetik", "penjaga", "helper", "operator", "kasir", "customer service", "cs online",
            "staff gudang", "sales promotion", "spg", "buruh",
        ),
        "currency": ("rp", "idr"), "dot_is_thousands": True, "floor": 100_000, "ceiling": 500_000_000,
    },
}

#: What a mention looks like.
#: Possessive and begun only where a run of such characters begins or the last address ended: so it neither recurses nor looks at a run again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'\[\]{}|\\^`]+"
PHONE = r"(?<![\d.])(?:\+62|62|0)[\s-]?8[1-9][\d\s-]{6,14}\d(?![\d.])"
COMPANY = r"(?U)\b(PT|CV|UD|PD|Perum|Perumda|Yayasan|Koperasi)\.?[ \t]+([A-Z][A-Za-z0-9&]*(?:[ \t]+[A-Z][A-Za-z0-9&]*){0,4})"
TITLE_CHARS = 120
