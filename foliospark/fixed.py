"""Lists, thresholds and patterns that decide the results.

Nothing here is logic.  Patterns are plain regular expressions without flags; the functions that
use them add the flags.
"""

# --------------------------------------------------------------------------------------------
# Labels and files
# --------------------------------------------------------------------------------------------

CATEGORY_FOLDERS = {
    "invoices": "Invoice",
    "emails": "Email",
    "questionnaires": "Questionnaire",
    "resumes": "Resume",
}
CLASS_LABELS = ["Invoice", "Email", "Questionnaire", "Resume"]
PDF_SUFFIX = ".pdf"
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"]
SUPPORTED_SUFFIXES = [PDF_SUFFIX] + IMAGE_SUFFIXES
MAX_UPLOAD_BYTES = 32 * 1024 * 1024
SPLIT_NAMES = ["train", "val", "test"]

# --------------------------------------------------------------------------------------------
# thresholds
# --------------------------------------------------------------------------------------------

MIN_NATIVE_CHARS = 50
MIN_ENGINE_WORDS = 20
MIN_USABLE_WORDS = 5
LOW_QUALITY_WORDS = 30
MIN_LANGUAGE_WORDS = 10
UNCERTAIN_BELOW = 0.45
TIER_HIGH = 70
TIER_MID = 45
PREVIEW_CHARS = 500
CARD_CHARS = 2000
TEST_SHARE = 0.2
SEED = 42
C_GRID = [0.01, 0.1, 1.0, 5.0, 10.0, 50.0]
DEFAULT_C = 1.0
MAX_FOLDS = 5
MIN_DOCUMENTS = 4
MAX_FEATURES = 15000
MIN_DF = 3
WHITE_LEVEL = 248
BLACK_LEVEL = 7
BLANK_SHARE = 0.998
DARK_PAGE_MEAN = 127
DARK_BAND_MEAN = 100
BANDS = 10

# --------------------------------------------------------------------------------------------
# Whitespace and line ends as the Python string type defines them
# --------------------------------------------------------------------------------------------

SPACE_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END_CHARS = r"\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029"

# --------------------------------------------------------------------------------------------
# Language codes
# --------------------------------------------------------------------------------------------

LANGUAGE_NAMES = {
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "pt": "Portuguese",
    "it": "Italian",
    "nl": "Dutch",
    "pl": "Polish",
    "ru": "Russian",
    "zh-cn": "Chinese",
    "zh-tw": "Chinese",
    "ja": "Japanese",
    "ar": "Arabic",
    "ko": "Korean",
}
UNKNOWN_LANGUAGE = "unknown"
TRUSTED_LANGUAGES = ["en", "unknown"]

# --------------------------------------------------------------------------------------------
# OCR corrections, applied in this order
# --------------------------------------------------------------------------------------------

OCR_FIXES = [
    (r"(?<![A-Za-z0-9])\|(?![A-Za-z0-9])", "I"),
    (r"\|([a-z])", "I$1"),
    (r"\brn\b", "m"),
    (r"(?<=[a-z])rn(?=[a-z])", "m"),
    (r"(?<=[a-z])vv(?=[a-z])", "w"),
    (r"(?<=[A-Za-z])0(?=[A-Za-z])", "O"),
    (r"(?<=\d)l(?=\d)", "1"),
    (r"\bl(\d)", "1$1"),
    (r"\bS\s(?=\d)", r"\$ "),
    ("\ufb01", "fi"),
    ("\ufb02", "fl"),
    ("\u2019", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
    ("\f", "\n"),
    (r"\n{3,}", "\n\n"),
]

# --------------------------------------------------------------------------------------------
# Structural features (case-insensitive, multi-line)
# --------------------------------------------------------------------------------------------

STRUCTURAL_FEATURES = {
    "inv_currency": r"[\$€£¥]",
    "inv_total": r"\btotal\b",
    "inv_amount_due": r"\bamount\s+due\b|\bbalance\s+due\b|\bdue\s+date\b",
    "inv_invoice_kw": r"\binvoice\b",
    "inv_bill_to": r"\bbill\s+to\b|\bship\s+to\b|\bsold\s+to\b",
    "inv_subtotal": r"\bsubtotal\b|\bsub-total\b|\btax\b|\bvat\b",
    "inv_number": r"\binv[\s\-#:]+\d+|\binvoice\s*(no|num|number|#)",
    "email_at": r"@[a-z0-9]+\.[a-z]{2,}",
    "email_dear": r"\bdear\s+\w+",
    "email_regards": r"\bregards\b|\bsincerely\b|\bbest\s+wishes\b|\bthank\s+you\b",
    "email_subject": r"\bsubject\s*:",
    "email_from": r"\bfrom\s*:|\bto\s*:|\bcc\s*:|\bfwd\b|\bforwarded\b",
    "res_experience": r"\bexperience\b|\bemployment\b|\bwork\s+history\b",
    "res_education": r"\beducation\b|\bdegree\b|\buniversity\b|\bcollege\b|\bgpa\b",
    "res_skills": r"\bskills\b|\bproficient\b|\bprogramming\b|\bcertif",
    "res_objective": r"\bobjective\b|\bsummary\b|\bprofile\b|\breferences\b",
    "que_checkbox": r"[\u25a1\u2610\u2611\u2612]|\[\s*\]|\(\s*\)",
    "que_scale": r"\bstrongly\s+(agree|disagree)\b|\brate\b|\bscale\b|\blikert\b",
    "que_question": r"\bq\s*\d+\b|^\s*\d+[\.\)]\s+\w",
    "que_circle": r"\bplease\s+(circle|tick|check|mark|select)\b",
}

# --------------------------------------------------------------------------------------------
# Invoice patterns
# --------------------------------------------------------------------------------------------

MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?"
    r"|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATE = (
    r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}"
    r"|\b\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}"
    r"|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:of\s+)?" + MONTH + r"[a-z]*[\s,]+\d{2,4}"
    r"|\b" + MONTH + r"[a-z]*[\s,]+\d{1,2}(?:st|nd|rd|th)?[\s,]+\d{2,4}"
)
INVOICE_NUMBERS = [
    r"(?i)(?:invoice|inv)[\s\-]*(?:no\.?|num(?:ber)?|#|id)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-_/\.]{1,24})",
    r"(?i)\binvoice\s*[:\-]\s*([A-Z0-9][A-Z0-9\-_/\.]{1,24})",
    r"(?i)(?:reference|ref|document|doc)[\s\-]*(?:no\.?|num(?:ber)?|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-_/\.]{1,24})",
    r"(?i)(?:order|purchase\s*order|po)[\s\-]*(?:no\.?|num(?:ber)?|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-_/\.]{1,24})",
    r"\b((?:INV|PO|DOC|REF|ORD|BILL)[\-_]?[A-Z0-9]{2,20})\b",
]
INVOICE_DATE_LABELS = [
    r"invoice\s*date",
    r"date\s*of\s*invoice",
    r"date\s*of\s*issue",
    r"issue\s*date",
    r"billing\s*date",
    r"billed\s*date",
    r"invoice\s*issued",
    r"\bdate\b",
]
DUE_DATE_LABELS = [
    r"due\s*date",
    r"payment\s*due(?:\s*date)?",
    r"pay(?:ment)?\s*by",
    r"payable\s*(?:by|on|before)",
    r"terms?\s*due",
    r"net\s*\d+",
    r"please\s*pay\s*by",
]
CURRENCY = r"(?:USD|EUR|GBP|CAD|AUD|CHF|[$€£¥₹])"
TOTAL_LABELS = [
    r"grand\s*total",
    r"total\s*(?:amount\s*)?due",
    r"total\s*payable",
    r"amount\s*(?:due|payable|owed)",
    r"balance\s*(?:due|payable|owed|forward)",
    r"total\s*(?:including|incl\.?)\s*(?:vat|tax)",
    r"total\s*(?:excluding|excl\.?)\s*(?:vat|tax)",
    r"invoice\s*total",
    r"\btotal\b",
]
TOTAL_AMOUNT = r"([\d][\d\s,\.]{0,15})"
WORD_AMOUNT = r"[$€£]?\s*([\d,]+\.?\d*)"
NEAREST_AMOUNTS = 5
RECIPIENT_LABEL = (
    r"(?:bill(?:ed)?\s*to|sold\s*to|ship(?:ped)?\s*to|client|attention|attn\.?|customer)\s*[:\-]?\s*\n?"
)
ISSUER_LABEL = (
    r"(?:from|issued\s*by|vendor|supplier|service\s*provider|seller|company)\s*[:\-]?\s*\n?"
)
SNIPPET_CHARS = 300
NAME_MIN = 2
NAME_MAX = 80
TOP_LINES = 20
SNIPPET_SKIP = r"\b(invoice|total|amount|date|due|tax|vat|www\.|http)"
SNIPPET_NUMBER_LINE = r"[\d\s\-\+\(\)]{4,}"
TOP_SKIP = (
    r"\b(invoice|receipt|bill|statement|date|total|amount|tax|vat"
    r"|due|payment|no\.|number|tel|phone|fax|email|www\.|http|page)\b"
)
TOP_NUMBER_LINE = r"[\d\s\-\+\(\)\./,@]{4,}"
SUBTOTAL = r"(?:sub[\s\-]?total|net\s*amount)[:\s]*[$€£]?\s*([\d,]+\.?\d*)"
TAX = r"(?:tax|vat|gst|hst)[:\s]*[$€£]?\s*([\d,]+\.?\d*)"
MATH_TOLERANCE = 0.05
EUROPEAN_NUMBER = r"^\d{1,3}(?:\.\d{3})+,\d{2}$"

# --------------------------------------------------------------------------------------------
# E-mail, questionnaire and resume patterns
# --------------------------------------------------------------------------------------------

ADDRESS_CHARS = r"a-zA-Z0-9._%+-"
ADDRESS_DOMAIN = r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
QUESTION_LINE = r"^\s*(.+?\?)\s*$"
NUMBERED_LINE = r"^\s*(?:Q\s*)?\d+\s*[\.\)]\s*(.+?)\s*$"
CHECKBOX_LINE = r"^\s*(\[(?:x|X|\s)\]|\((?:x|X|\s)\))\s*(.+?)\s*$"
KEY_VALUE_LINE = r"^\s*([A-Za-z0-9][^:\n]{2,}?)\s*[:\-]\s*(.+?)\s*$"
PHONE = r"(\+?\d{1,3}[\s\.-]?)?(\(?\d{2,4}\)?[\s\.-]?)\d{3,4}[\s\.-]?\d{3,4}"
LINK = r"\bhttps?://[^\s\)\]]+\b"
NAME_DIGITS = r"\d{3}[\s\.-]?\d{3}"
NAME_HEADINGS = ["resume", "curriculum vitae", "cv"]
NAME_LIMIT = 60
RESUME_HEADINGS = [
    "summary",
    "professional summary",
    "objective",
    "experience",
    "work experience",
    "employment",
    "education",
    "skills",
    "projects",
    "certifications",
    "languages",
    "awards",
    "publications",
]

# --------------------------------------------------------------------------------------------
# messages
# --------------------------------------------------------------------------------------------

NO_TEXT_ERROR = (
    "Could not extract any text from the PDF. The pages may be blank or completely unreadable."
)
LOW_QUALITY_ERROR = (
    "Could not extract meaningful text. "
    "The image may be blank, pure noise, or too degraded for OCR."
)
BLANK_WHITE_ERROR = (
    "The image appears to be blank (near-white). Please upload a document with visible content."
)
BLANK_BLACK_ERROR = "The image appears to be entirely black or severely underexposed."
FEW_WORDS_WARNING = (
    "Only %d words were extracted. "
    "The document may contain heavy handwriting, noise, or a low-quality scan."
)
LANGUAGE_WARNING = (
    "⚠ NON-ENGLISH DOCUMENT DETECTED (%s). "
    "This model was trained exclusively on English documents. "
    "The result shown below should NOT be relied upon."
)
EM_DASH = "—"
NO_TEXT_SHOWN = "(no text extracted)"

# --------------------------------------------------------------------------------------------
# English stop words of three letters and more (shorter tokens are dropped anyway),
# with the pieces that contractions leave once the apostrophe is gone
# --------------------------------------------------------------------------------------------

STOP_WORDS = """
about above after again against ain all and any are aren because been before being below between
both but can couldn did didn does doesn doing don down during each few for from further had hadn
has hasn have haven having her here hers herself him himself his how into isn its itself just
mightn more most mustn myself needn nor not now off once only other our ours ourselves out over
own per same shan she should shouldn some such than that the their theirs them themselves then
there these they this those through too under until very was wasn were weren what when where
which while who whom why will with won wouldn you your yours yourself yourselves
""".split()

# --------------------------------------------------------------------------------------------
# Noun forms and their lemmas.  Forms that are not listed stay as they are; a larger
# table can be passed to the operators.
# --------------------------------------------------------------------------------------------

LEMMAS = dict(
    pair.split(":")
    for pair in """
    accounts:account addresses:address amounts:amount analyses:analysis analysts:analyst
    answers:answer applications:application articles:article attachments:attachment
    awards:award balances:balance banks:bank benefits:benefit bills:bill boxes:box
    brands:brand budgets:budget businesses:business buyers:buyer candidates:candidate
    categories:category certificates:certificate charges:charge children:child cities:city
    classes:class clicks:click clients:client colleges:college comments:comment
    companies:company contacts:contact contracts:contract copies:copy costs:cost
    countries:country courses:course criteria:criterion customers:customer
    dates:date days:day degrees:degree deliveries:delivery departments:department
    details:detail developers:developer discounts:discount documents:document emails:email
    employees:employee engineers:engineer entries:entry errors:error events:event
    examples:example fees:fee feet:foot fields:field files:file firms:firm forms:form
    goals:goal goods:good grades:grade groups:group hours:hour indices:index industries:industry
    interests:interest invoices:invoice items:item jobs:job journals:journal knives:knife
    languages:language leaves:leaf letters:letter levels:level lines:line links:link
    lives:life machines:machine managers:manager markets:market meetings:meeting men:man
    messages:message methods:method months:month names:name notes:note numbers:number
    offices:office options:option orders:order pages:page papers:paper parties:party
    parts:part payments:payment periods:period phones:phone policies:policy prices:price
    processes:process products:product profiles:profile programs:program projects:project
    publications:publication purchases:purchase quantities:quantity questions:question
    rates:rate receipts:receipt records:record reports:report requests:request
    responsibilities:responsibility results:result roles:role sales:sale scales:scale
    schools:school sections:section services:service skills:skill statements:statement
    students:student studies:study suppliers:supplier surveys:survey systems:system
    tables:table taxes:tax teams:team teeth:tooth terms:term texts:text totals:total
    units:unit universities:university users:user values:value vendors:vendor views:view
    weeks:week wives:wife women:woman words:word years:year
    """.split()
)
