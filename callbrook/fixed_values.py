"""Values the results depend on.

FIXED VALUES: word lists, patterns, tables and constants below are part of the
data contract.  Results are only comparable between systems when these match,
so they are stated plainly, in their natural order, and used as parameters.
Every operator takes them as defaults; none is hard-wired.
"""

# --- sources -----------------------------------------------------------------

SOURCE_TYPE_BY_EXTENSION = {
    ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".csv": "csv",
    ".html": "html", ".htm": "html", ".txt": "txt", ".md": "txt",
    ".png": "image", ".jpg": "image", ".jpeg": "image",
    ".tiff": "image", ".tif": "image", ".bmp": "image",
}

HTML_BOILERPLATE_TAGS = (
    "nav", "footer", "header", "aside", "script", "style", "noscript", "meta", "link",
)
HTML_HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# --- cleaning ----------------------------------------------------------------

NAVIGATION_PATTERNS = (
    r"^(home|about|contact|privacy|terms|sitemap|menu|login|sign up|sign in|register)\s*$",
    r"^(cookie|accept|decline|preferences|settings)\s",
    r"^©\s*\d{4}",
    r"^all rights reserved",
    r"^page \d+ of \d+$",
    r"^\d+\s*$",
)
FOOTER_PATTERNS = (r"^confidential", r"^internal use only", r"^draft")

# canonical form -> aliases
KB_TERMINOLOGY = (
    ("business loan", ("business financing", "SME loan", "commercial loan", "business credit")),
    ("monthly revenue", ("monthly income", "monthly turnover", "monthly sales", "revenue per month")),
    ("loan amount", ("requested amount", "financing amount", "credit amount", "loan value")),
    ("interest rate", ("rate of interest", "lending rate", "borrowing rate")),
    ("eligibility", ("qualification", "qualification criteria", "eligibility criteria", "requirements")),
)

# --- personal data -----------------------------------------------------------

PII_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PII_PHONES = (
    r"\+?\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b\d{10,12}\b",
)
PII_ACCOUNTS = (
    r"\b(?:account|acct|acc)[#:\s-]*\d{4,}\b",
    r"\b(?:policy|pol)[#:\s-]*\d{4,}\b",
    r"\b(?:customer|cust|cid)[#:\s-]*\d{4,}\b",
)
PII_TITLED_NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"
PII_CONFIDENCE = {"email": 0.99, "phone": 0.85, "account_id": 0.90, "person_name": 0.70}

EVENT_EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
EVENT_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EVENT_EMAIL_MASK = "[EMAIL_PROTECTED]"
EVENT_PHONE_MASK = "[PHONE_PROTECTED]"

# --- conflicts ---------------------------------------------------------------

AMOUNT_PATTERN = r"\$?([\d,]+(?:\.\d+)?)\s*(?:million|M|thousand|K)?"
NEAR_DUPLICATE_THRESHOLD = 0.90

# --- retrieval ---------------------------------------------------------------

STOPWORDS = tuple("""
a about above after again against all am an and any are as at be because been
before being below between both but by could did do does doing down during each
few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not now
of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while
who whom why with would you your yours yourself yourselves
""".split())

GATE_STOPWORDS = tuple("""
what why how when where who which can could would should is are was were the a
an and or for with to of in on at by from there this that these those about have
has had been being does did
""".split())

BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.5, 0.75, 0.01
EMBED_DIM, EMBED_UNIGRAM, EMBED_BIGRAM, EMBED_NUMBER = 384, 3.0, 0.5, 2.0
RRF_K, FUSION_ALPHA, TOP_K = 60, 0.50, 5
RERANK_PHRASE, RERANK_TITLE, RERANK_NUMERIC, RERANK_COVERAGE = 0.25, 0.25, 0.20, 0.30
GATE_THRESHOLD, GATE_WEAK = 0.60, 0.20
GATE_TOP, GATE_COVERAGE, GATE_MARGIN = 0.50, 0.45, 0.05
ABSTENTION = "I don't have verified information about that."
CHUNK_SIZE, CHUNK_OVERLAP = 512, 64

# --- call signals ------------------------------------------------------------

# (rule, signal type, confidence, severity, speaker or None, needs prior disclosure, patterns)
SIGNAL_RULES = (
    ("cross_sell_second_vehicle", "missed_opportunity", 0.88, "medium", "CUSTOMER", False, (
        r"\b(another|second|2nd|other)\s+(vehicle|car|motorcycle|motor|truck|auto)\b",
        r"\b(mobil|motor|kendaraan)\s+(lain|kedua|satu lagi)\b",
        r"\bmay\s+(isa\s+pang|isa\s+pang\s+sasakyan|pangalawang\s+kotse)\b")),
    ("cross_sell_family_dependent", "missed_opportunity", 0.86, "medium", "CUSTOMER", False, (
        r"\b(also|extra|additional)\s+(coverage|insurance|policy)\s+for\s+my\s+(wife|husband|child|son|daughter|family)\b",
        r"\b(asuransi|perlindungan)\s+(buat|untuk)\s+(anak|istri|suami|keluarga)\b",
        r"\bpara\s+sa\s+(anak|asawa|pamilya)\s+ko\b")),
    ("cross_sell_second_business", "missed_opportunity", 0.87, "medium", "CUSTOMER", False, (
        r"\b(second|another|2nd)\s+(branch|business|store|company|shop)\b",
        r"\b(cabang|usaha|toko|bisnis)\s+(kedua|lain|baru)\b")),
    ("compliance_missing_recording_disclosure", "compliance_gap", 0.92, "critical", None, True, (
        r"\b(social security|credit card|bank account|income|revenue|gaji|npwp|rekening)\b",)),
    ("compliance_explicit_rate_guarantee_risk", "compliance_gap", 0.94, "critical", "AGENT", False, (
        r"\b(guaranteed\s+(return|approval|zero\s+risk)|pasti\s+cair\s+tanpa\s+syarat|walang\s+risk)\b",)),
    ("callback_busy_driving", "callback_need", 0.92, "medium", "CUSTOMER", False, (
        r"\b(call\s+(me\s+)?back|call\s+later|busy\s+right\s+now|driving\s+right\s+now|in\s+a\s+meeting)\b",
        r"\b(hubungi\s+(saya\s+)?nanti|telepon\s+lagi\s+nanti|lagi\s+sibuk|lagi\s+di\s+jalan|lagi\s+meeting)\b",
        r"\b(tumawag\s+(na\s+lang\s+)?mamaya|busy\s+ako\s+ngayon|nagmamaneho\s+ako)\b")),
    ("financial_risk_inability_to_pay", "risk", 0.90, "high", "CUSTOMER", False, (
        r"\b(can'?t\s+pay|cannot\s+afford|lost\s+my\s+job|bankruptcy|behind\s+on\s+payments|financial\s+hardship)\b",
        r"\b(nggak\s+sanggup\s+bayar|tidak\s+bisa\s+bayar|kehilangan\s+pekerjaan|kena\s+phk|gagal\s+bayar)\b",
        r"\b(hindi\s+ko\s+kayang\s+bayaran|nawalan\s+ng\s+trabaho|nagigipit\s+ako)\b")),
    ("customer_frustration_repetition_delay", "frustration", 0.93, "high", "CUSTOMER", False, (
        r"\b(explained\s+this\s+(three|multiple|several|2|3)\s+times|taking\s+so\s+long|speak\s+to\s+(your\s+)?(manager|supervisor)|waste\s+of\s+(my\s+)?time|ridiculous)\b",
        r"\b(sudah\s+(tiga|berkali-kali)\s+kali\s+saya\s+jelaskan|lama\s+banget|mana\s+manajer|buang-buang\s+waktu|bikin\s+emosi)\b",
        r"\b(pangatlong\s+beses\s+ko\s+nang\s+paliwanag|ang\s+tagal-tagal|nagsasayang\s+ng\s+oras|kakausapin\s+ko\s+ang\s+manager)\b")),
    ("customer_ready_to_buy", "buying_signal", 0.88, "medium", "CUSTOMER", False, (
        r"\b(ready\s+to\s+(buy|sign|proceed)|where\s+do\s+I\s+sign|take\s+my\s+card|send\s+the\s+agreement|sign\s+up\s+today)\b",
        r"\b(mau\s+ambil\s+(paket|penawaran)\s+ini|saya\s+setuju|kirim\s+kontraknya|langsung\s+proses\s+aja)\b",
        r"\b(kukunin\s+ko\s+na|pirmahan\s+ko\s+na|i-process\s+na\s+natin)\b")),
)
DISCLOSURE_PATTERN = r"\b(recorded|recording|quality\s+and\s+training|rekam|nirerekord)\b"
CONTEXT_TURNS = 25
PARTIAL_MIN_WORDS = 4
FIRST_TOPIC = "greeting"
TOPIC_CONFIDENCE = 0.82
TOPIC_KEYWORDS = (
    ("greeting", ("hello", "good morning", "magandang araw", "selamat siang", "kumusta")),
    ("qualification", ("annual revenue", "credit score", "years in business", "income", "pendapatan", "omzet")),
    ("pricing", ("interest rate", "premium", "down payment", "cicilan", "biaya", "pricing", "quote")),
    ("objection", ("too expensive", "not interested", "mahina", "berat", "ragu", "scam", "mahal")),
    ("payment", ("pay", "card", "transfer", "bank", "bayar", "rekening")),
    ("closing", ("bye", "thank you", "salamat", "terima kasih", "talk later")),
)

NUDGE_MIN_CONFIDENCE, NUDGE_HIGH_CONFIDENCE = 0.70, 0.85
NUDGE_COOLDOWN, NUDGE_COMPLIANCE_COOLDOWN, NUDGE_EXPIRY = 30.0, 15.0, 45.0
NUDGE_MESSAGES = {
    "compliance_gap": "Required disclosure appears missing. Deliver mandatory call recording disclosure before proceeding.",
    "vehicle": "Customer mentioned a second vehicle. Check multi-vehicle offer.",
    "family": "Customer mentioned family members. Inquire if dependent coverage add-on is desired.",
    "missed_opportunity": "Customer referenced an additional business or property. Probe for cross-sell eligibility.",
    "callback_need": "Customer requested callback. Confirm preferred phone number and callback time.",
    "frustration": "Customer expressed frustration over delays. Acknowledge concern and clarify the next step.",
    "risk": "Customer signaled payment difficulty. Inquire about grace period or restructuring options.",
    "buying_signal": "Customer indicated intent to proceed. Present enrollment agreement or closing steps.",
}
TOPIC_SHIFT_MESSAGE = ("Customer shifted focus to ", ". Address questions before returning to qualification.")
OTHER_MESSAGE = "Review customer statement: "

# --- qualification -----------------------------------------------------------

# tier, min monthly revenue, min years, max loan, term months, interest rate
TIERS = (
    ("Starter", 500000.0, 2.0, 2000000.0, 12, 12.5),
    ("Growth", 1000000.0, 2.0, 5000000.0, 24, 10.0),
    ("Premium", 2500000.0, 3.0, 15000000.0, 60, 8.5),
    ("Enterprise", 5000000.0, 5.0, 50000000.0, 84, 7.0),
)
MANDATORY_FIELDS = ("business_type", "years_in_business", "monthly_revenue", "requested_amount")
MIN_YEARS, MIN_REVENUE = 2.0, 500000.0

NUMBER_WORDS = (
    ("ten", 10), ("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50),
    ("sixty", 60), ("seventy", 70), ("eighty", 80), ("ninety", 90), ("hundred", 100),
)
MONEY_UNITS = r"\b(thousand|million|k|m|lakh|crore|usd|dollars?)\b"
CONSENT_YES = ("yes", "sure", "ok", "agree", "proceed", "fine", "approved")
CONSENT_NO = ("no", "never", "don't", "refuse", "stop")

# --- intents and field extraction --------------------------------------------

HUMAN_PHRASES = (
    "human", "representative", "specialist", "agent", "person", "manager", "operator",
    "speak with someone", "talk to someone", "connect me", "real person",
)
OBJECTION_PHRASES = ("too long", "too high", "not fair", "that's too", "why do i need")
QUESTION_PHRASES = (
    "why", "how", "rate", "document", "requirement", "can i", "what is",
    "tell me about", "interested in", "qualify for",
)
BUSINESS_TYPES = (
    ("retail", ("retail", "shop", "store", "boutique", "showroom", "outlet",
                "clothing store", "electronics shop", "general store")),
    ("restaurant", ("restaurant", "cafe", "eatery", "food", "dhaba", "hotel",
                    "canteen", "bakery", "mess", "tiffin")),
    ("manufacturing", ("manufacturing", "factory", "production", "assembly",
                       "plant", "mill", "fabrication")),
    ("construction", ("construction", "builder", "contractor", "infrastructure",
                      "real estate developer", "civil")),
    ("technology", ("technology", "tech", "software", "it company", "startup",
                    "app", "digital", "saas", "ecommerce", "e-commerce")),
    ("logistics", ("logistics", "transport", "delivery", "freight", "courier",
                   "shipping", "trucking")),
    ("trading", ("trading", "import", "export", "distribution", "wholesale",
                 "merchant", "commodities")),
    ("healthcare", ("healthcare", "clinic", "hospital", "medical", "pharmacy",
                    "health", "diagnostic", "lab")),
    ("services", ("services", "service provider", "consultancy", "consulting",
                  "agency", "outsourcing", "bpo")),
    ("agriculture", ("agriculture", "farming", "farm", "agri", "crop", "dairy", "poultry")),
    ("education", ("education", "school", "training", "coaching", "institute",
                   "college", "tutoring")),
)
AMOUNT_UNITS = (
    (r"(\d+(?:\.\d+)?)\s*(?:crore|cr)\b", 10000000.0),
    (r"(\d+(?:\.\d+)?)\s*(?:lakh|lac)\b", 100000.0),
    (r"(\d+(?:\.\d+)?)\s*(?:million|m)\b", 1000000.0),
    (r"(\d+(?:\.\d+)?)\s*(?:thousand|k)\b", 1000.0),
)
REVENUE_CONTEXT = (
    r"(?:monthly\s+revenue|revenue|monthly\s+income|earnings?|monthly|turnover)"
    r"\s+(?:is|of|are|was|around|about|roughly|approximately)?\s*"
    r"(?:about|around|roughly|approximately)?\s*([^\.\,\?]+)"
)
LOAN_CONTEXT = (
    r"(?:loan\s*(?:of|amount)?|borrow(?:ing)?|need(?:ing)?|requesting?|looking\s+for)"
    r"\s+(?:around|about|roughly|approximately)?\s*([^\.\,\?]+)"
)
YEARS_PATTERN = r"(\d+(?:\.\d+)?)\s*(?:years?|yrs?)\b"
MONTHS_PATTERN = r"(\d+(?:\.\d+)?)\s*months?\b"
PERMISSION_PHRASES = (
    "yes", "sure", "ok", "agree", "proceed", "fine", "go ahead",
    "permission", "you have my", "contact me",
)

# the base agent's narrower extractor: last matching type wins
BASE_TYPES = (
    "retail", "restaurant", "manufacturing", "construction",
    "technology", "logistics", "trading", "healthcare",
)
BASE_REVENUE = (
    r"(?:monthly\s+revenue|revenue|earnings?|monthly\s+income|monthly)\s+"
    r"(?:is|of|around|about|roughly|approximately|\s)*[\$]?([0-9\.]+\s*(?:thousand|million|k|m)?|[a-z]+)"
)
BASE_REVENUE_SKIP = ("of", "is", "around", "a", "about", "revenue")
BASE_REVENUE_WORDS = ("fifty", "forty", "thirty", "twenty", "sixty", "seventy", "eighty", "ninety")
BASE_LOAN = (
    r"(?:loan\s*amount|borrow|loan\s*of|request(?:ing)?|need\s*to\s*borrow|need)\s+"
    r"(?:is|of|around|about|roughly|approximately|to|for|\s)*[\$]?([0-9\.]+\s*(?:thousand|million|k|m)?|[a-z]+)"
)
BASE_LOAN_SKIP = ("of", "a", "for", "to", "amount", "loan", "borrow")
BASE_PERMISSION = (
    "permission", "contact me", "proceed", "agree", "consent",
    "yes, you have", "you have my permission",
)
BASE_PURPOSE = r"for\s+([a-z\s]+?)(?:\.|$|,)"
BASE_PURPOSE_SKIP = ("a", "the", "my")
BASE_HUMAN_PHRASES = (
    "human", "representative", "specialist", "agent", "person", "manager",
    "operator", "speak with someone", "talk to someone",
)
BASE_QUESTION_PHRASES = (
    "too long", "too high", "why", "how", "rate", "document", "requirement",
    "can i", "what", "which", "product", "offer", "interest", "collateral",
    "penalty", "grace period", "fee", "approval", "question", "faq", "policy",
)

# --- localization ------------------------------------------------------------

ESCALATE_COMMON = ("human", "representative", "specialist", "agent", "person", "operator",
                   "speak with someone", "talk to someone")
ESCALATE_MARKET = {
    "PH": ("makausap", "kinatawan", "taong kausap", "specialist", "agent", "tao", "branch"),
    "ID": ("bicara dengan orang", "staf", "customer service", "manusia", "petugas",
           "hubungkan ke orang", "ngomong sama orang"),
}
OBJECT_COMMON = ("too long", "too high", "why do i need", "ridiculous", "cannot provide")
OBJECT_MARKET = {
    "PH": ("mahal", "mataas ang premium", "hindi ko kaya", "may insurance na", "pag-iisipan",
           "too expensive", "worried", "alala", "baka mag-lapse", "mag-lapse"),
    "ID": ("kemahalan", "bunganya tinggi", "denda terlalu besar", "tenor kepanjangan",
           "pikir-pikir", "dp-nya berat", "denda keterlambatan", "takut denda", "denda"),
}
QUESTION_COMMON = ("what", "how", "can i", "do you", "which", "where", "is there", "why")
QUESTION_MARKET = {
    "PH": ("ano", "paano", "magkano", "kailan", "pwede ba", "mayroon ba", "saan", "ilang", "bakit", "alin"),
    "ID": ("apa", "bagaimana", "gimana", "berapa", "kapan", "apakah", "bisa nggak", "di mana", "kenapa", "mengapa"),
}
KB_CLAUSE_KEYWORDS = ("grace period", "denda", "cicilan", "tenor", "dp", "lapse", "premium", "rider", "jatuh tempo")
LOCAL_TYPES = (
    "retail", "restaurant", "manufacturing", "construction", "technology", "logistics",
    "trading", "healthcare", "usaha toko", "bengkel", "kuliner", "karyawan", "pns", "freelance",
)
LOCAL_YEARS = r"(\d+(?:\.\d+)?)\s*(?:years?|yrs?|taon|tahun)\b"
LOCAL_REVENUE = (
    r"(?:monthly\s+revenue|revenue|income|gaji|penghasilan|omzet|kita|kinikita)\b.*?\b"
    r"([0-9\.]+\s*(?:thousand|million|juta|jt|ribu|rb|k|m)?)\b"
)
LOCAL_REVENUE_WORDS = ("fifty", "lima puluh", "limampu", "forty")
LOCAL_LOAN = (
    r"(?:loan\s*amount|borrow|loan\s*of|request(?:ing)?|need\s*to\s*borrow|need|pinjam|pengajuan|coverage|plafon|target)"
    r"\b.*?\b([0-9\.]+\s*(?:thousand|million|juta|jt|ribu|rb|k|m)?)\b"
)
LOCAL_NUMBER_WORDS = (
    ("satu", 1.0), ("dua", 2.0), ("tiga", 3.0), ("empat", 4.0), ("lima", 5.0),
    ("isa", 1.0), ("dalawa", 2.0), ("tatlo", 3.0), ("apat", 4.0),
    ("one", 1.0), ("two", 2.0), ("three", 3.0), ("four", 4.0), ("five", 5.0),
)
LOCAL_PERMISSION = (
    "permission", "contact me", "proceed", "agree", "consent",
    "yes", "oo", "opo", "payag", "sige", "boleh", "bisa", "bersedia", "setuju", "ya",
)

FILIPINO_MARKERS = tuple("""
ang ng mga sa ay si ni kay po opo ho ba na pa naman kasi kaya pero para kung kapag
ito iyan iyon dito diyan doon ako ikaw siya kami tayo kayo sila gusto kailangan
meron wala oo hindi salamat magkano ano paano kailan saan maganda magandang araw
inyo nais ibig ko mo sanang sana magtanong ukol proteksyon buhay pamilya
""".split())
PH_ENGLISH_WORDS = tuple("""
insurance policy premium coverage beneficiary rider loan interest bank
bancassurance plan renewal account monthly payment application
""".split())
PH_POLITE_WORDS = ("po", "opo", "ho")
PH_SWITCH_PREFIX = r"^(?:mag|nag|i|pag|na)-[a-z]+"
# the two-word entry can never equal one token; it stays part of the list
INDONESIAN_FORMAL = tuple("""
saya anda bapak ibu beliau kami mereka dengan untuk adalah sebagai bahwa dalam
dapat akan telah apakah bagaimana mengapa mohon silakan pembiayaan angsuran
kewajiban persyaratan ketentuan
""".split()) + ("terima kasih",)
INDONESIAN_COLLOQUIAL = tuple("""
aku kamu lu gue gw loe lo elu nggak gak ngga enggak udah udh gimana gmn bisa bs
dong deh sih nih tuh aja kok banget bgt beneran kalo kl pengen nyari dp-nya
cicilannya kak bro sis
""".split())
ID_LOANWORDS = tuple("""
down payment dp tenor leasing multifinance rate credit score survey approval online
""".split())

# market -> (concept, term, variants)
MARKET_TERMS = {
    "PH": (
        ("premium", "premium", ("hulog", "bayad", "monthly premium", "annual premium", "premiums")),
        ("policy", "policy", ("polisiya", "plan", "insurance plan", "policy plan")),
        ("beneficiary", "beneficiary", ("makakatanggap", "benepisyaryo", "dependent", "designated heir")),
        ("rider", "rider", ("add-on", "additional benefit", "dagdag coverage", "supplementary benefit")),
        ("lapse", "lapse", ("mawalan ng bisa", "maputol ang coverage", "lapsed", "inactive policy")),
        ("coverage", "coverage", ("proteksyon", "sum assured", "insurance coverage", "sakop")),
        ("bank_referral", "bank referral", ("referral sa branch", "endorsement", "branch endorsement", "partner bank")),
        ("grace_period", "grace period", ("palugit", "31-day grace period", "extension para magbayad")),
    ),
    "ID": (
        ("installment", "cicilan", ("angsuran", "pembayaran berkala", "cicil", "cicilannya")),
        ("tenor", "tenor", ("jangka waktu", "periode kredit", "durasi pembiayaan", "bulan")),
        ("late_penalty", "denda", ("denda keterlambatan", "pinalti", "biaya denda", "denda per hari")),
        ("down_payment", "DP", ("uang muka", "down payment", "DP-nya", "dp")),
        ("due_date", "jatuh tempo", ("tanggal jatuh tempo", "tenggat waktu", "batas bayar", "jatuh temponya")),
        ("installment_formal", "angsuran", ("cicilan", "angsuran bulanan", "pembayaran angsuran")),
        ("financing", "pembiayaan", ("kredit", "pinjaman", "multifinance", "fasilitas dana")),
        ("early_payoff", "pelunasan dipercepat", ("pelunasan awal", "prepayment", "tutup pinjaman", "lunas duluan")),
    ),
}

# (language, reason, message)
FALLBACK_MESSAGES = (
    ("taglish", "unsupported_kb", "Pasensya na po, wala po akong verified na impormasyon tungkol diyan sa aming official guidelines. Gusto niyo po bang ikonekta ko kayo sa ating Bancassurance Specialist?"),
    ("taglish", "unclear_audio", "Pasensya na po, medyo hindi ko po naintindihan nang malinaw. Pwede po bang pakiulit?"),
    ("taglish", "tool_failure", "Paumanhin po, nagkaroon po ng technical delay sa aming system. I-record ko po ang inyong inquiry para matawagan kayo ng aming team."),
    ("taglish", "human_escalation", "Opo, nauunawaan ko po. I-transfer ko na po kayo ngayon sa ating insurance financial specialist. Sandali lamang po."),
    ("fil", "unsupported_kb", "Ipagpaumanhin po ninyo, wala po akong nahanap na opisyal na impormasyon ukol diyan sa ating gabay. Nais po ba ninyong makausap ang ating tagapayo sa bangko?"),
    ("fil", "unclear_audio", "Paumanhin po, hindi ko po gaanong narinig. Maaari po bang pakisabi muli?"),
    ("fil", "tool_failure", "Paumanhin po, may kaunting aberya sa sistema. Itatala ko po ito upang mabalikan kayo."),
    ("fil", "human_escalation", "Opo, agad ko po kayong ikokonekta sa isang kinatawan. Mangyaring maghintay po nang sandali."),
    ("en", "unsupported_kb", "I don't have verified information about that in our bancassurance policies. Would you like me to connect you with an insurance specialist?"),
    ("en", "unclear_audio", "I'm sorry, I didn't quite catch that. Could you please repeat?"),
    ("en", "tool_failure", "I apologize, our system is currently experiencing a temporary delay. I'll note your inquiry for a callback from our underwriting team."),
    ("en", "human_escalation", "Certainly. I am transferring you to a lending specialist right now. Please hold on."),
    ("id_formal", "unsupported_kb", "Mohon maaf Bapak/Ibu, kami belum memiliki informasi resmi mengenai hal tersebut pada basis data kami. Apakah berkenan saya sambungkan dengan staf layanan pembiayaan kami?"),
    ("id_formal", "unclear_audio", "Mohon maaf, suara Bapak/Ibu kurang terdengar jelas. Apakah bisa diulangi kembali?"),
    ("id_formal", "tool_failure", "Mohon maaf atas ketidaknyamanannya, sistem kami sedang mengalami kendala teknis. Data permohonan Anda telah kami catat untuk ditindaklanjuti oleh petugas kami."),
    ("id_formal", "human_escalation", "Baik Bapak/Ibu, saya akan segera menyambungkan panggilan ini ke staf customer service kami. Mohon ditunggu sejenak."),
    ("id_colloquial", "unsupported_kb", "Waduh mohon maaf Kak, info soal itu belum ada di panduan resmi kami nih. Mau aku hubungkan langsung sama customer service kami biar dibantu?"),
    ("id_colloquial", "unclear_audio", "Maaf Kak, tadi suaranya agak putus-putus. Boleh diulang lagi nggak?"),
    ("id_colloquial", "tool_failure", "Wah maaf banget Kak, sistemnya lagi agak lambat nih. Tenang aja, datanya udah aku simpan biar nanti dihubungi sama tim kami ya."),
    ("id_colloquial", "human_escalation", "Siap Kak, langsung aku sambungkan ke tim representatif kami ya. Ditunggu sebentar ya Kak."),
    ("id_mixed", "unsupported_kb", "Mohon maaf, informasi terkait hal tersebut belum tersedia di sistem kami. Apakah ingin dihubungkan langsung dengan staf pembiayaan kami?"),
    ("id_mixed", "unclear_audio", "Mohon maaf, suaranya kurang jelas. Bisa tolong diulangi kembali?"),
    ("id_mixed", "tool_failure", "Mohon maaf, terjadi kendala pada sistem. Catatan Anda telah kami simpan untuk penanganan lebih lanjut."),
    ("id_mixed", "human_escalation", "Baik, panggilan ini akan segera saya teruskan ke staf kami. Mohon ditunggu sebentar."),
)

# --- conversation states -----------------------------------------------------

# state -> states it may move to
STATE_MOVES = {
    "GREETING": ("UNDERSTAND_INTENT", "QUALIFICATION", "KNOWLEDGE_QUESTION", "OBJECTION", "ESCALATION", "END"),
    "UNDERSTAND_INTENT": ("QUALIFICATION", "KNOWLEDGE_QUESTION", "OBJECTION", "ESCALATION", "END"),
    "QUALIFICATION": ("KNOWLEDGE_QUESTION", "OBJECTION", "REVIEW", "ESCALATION", "END"),
    "KNOWLEDGE_QUESTION": ("QUALIFICATION", "OBJECTION", "REVIEW", "ESCALATION", "END"),
    "OBJECTION": ("QUALIFICATION", "KNOWLEDGE_QUESTION", "REVIEW", "ESCALATION", "END"),
    "REVIEW": ("LEAD_CONFIRMATION", "QUALIFICATION", "ESCALATION", "END"),
    "LEAD_CONFIRMATION": ("END", "ESCALATION"),
    "ESCALATION": ("END",),
    "END": (),
}
ALWAYS_REACHABLE = ("END", "ESCALATION")

# --- providers and evaluation ------------------------------------------------

RETRYABLE_CODES = (401, 403, 429, 500, 502, 503, 504)
RETRYABLE_PHRASES = ("rate limit", "429", "timeout", "timed out", "connection refused",
                     "503 service unavailable", "simulated failure")
UNHEALTHY_AFTER, DEGRADED_AFTER = 5, 2
FINANCE_TERMS = ("starter", "growth", "interest", "revenue", "loan", "lapse", "tenor", "cicilan", "denda")
COMPARISON_THRESHOLD = 0.60
FALLBACK_MARKERS = ("clarify", "don't have verified")
