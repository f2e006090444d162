"""Word lists, patterns and limits that decide results.

Java syntax without look-around except where noted, so most also run in other engines.
Hebrew alternatives never use word boundaries, because those are ASCII-only.
"""

HEBREW = r"[\x{0590}-\x{05FF}]"
ARABIC = r"[\x{0600}-\x{06FF}]"
LATIN = r"[A-Za-z]"

FILENAME_ALT = r"(?i)\.(jpe?g|png|gif|svg|webp)$"
PLAYER_HOST = r"(?i)youtube|youtu\.be|vimeo|dailymotion|wistia|jwplayer|kaltura|brightcove|soundcloud|spotify"
TYPED_BULLET = r"^[\-–—•*▪◦●·]|^\d+[.)]\s"
GENERIC_LINK = r"(?i)^(לחץ כאן|לחצו כאן|כאן|קרא עוד|קראו עוד|למידע נוסף|לפרטים|עוד|המשך|click here|read more|more|here|link|details)$"
URL_TEXT = r"(?i)^https?://"
NEW_WINDOW = r"(?i)חלון חדש|new window|נפתח בלשונית"
SAYS_REQUIRED = r"(?i)חובה|נדרש|שדה הכרחי|\brequired\b"
HIGH_STAKES = r"תשלום|לתשלום|רכישה|הזמנה|כרטיס אשראי|אשראי|סליקה|חתימה|הסכם|תנאי שימוש|ביטול|מחיקה|תרומה|payment|checkout|credit|purchase|donate|delete|subscribe"
COMPLEX_IMAGE = r"(?i)chart|graph|diagram|infographic|תרשים|גרף|תמונה מורכבת"
TEXT_IMAGE_HINT = r"banner|promo|sale|campaign|hero|poster|title|headline|infographic|screenshot|price|מבצע|באנר|כרזה"
LOGO_HINT = r"logo|לוגו|brand"
CLICKABLE_CLASS = r"\b(btn|button|clickable|link|toggle|tab|accordion|dropdown|close|menu-item)\b"
ICON_CLASS = r"icon|fa-|material-icons"
SKIP_TEXT = r"(?i)דלג|דילוג|skip|לתוכן"
STATEMENT_LINK = r"(?i)הצהרת נגישות|הצהרה על נגישות|accessibility.?statement|נגישות"
STATEMENT_EXPLICIT = r"(?i)הצהרת נגישות|accessibility.?statement"
SITEMAP_LINK = r"(?i)מפת אתר|מפת האתר|sitemap"
PAUSE_CONTROL = r"(?i)pause|stop|השהה|עצור|הפסק"
COORDINATOR = r"רכז(?:ת)? נגישות|ממונה נגישות"
BLOCKS_ZOOM = r"(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*(1(\.0)?|0)"
PHONE = r"0\d{1,2}[-\s]?\d{7}|\+972[-\s]?\d{1,2}[-\s]?\d{7}"
NINE_DIGITS = r"\b\d{9}\b"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
REFERENCE_CODE = r"\b[A-Z]{2,}-\d{3,}\b"
NOT_PROSE_NAME = r"(?i)^(https?://|www\.|mailto:|tel:|/|[\w.+-]+@)"
HOST_LIKE_NAME = r"(?i)^[\w.+-]+\.[a-z]{2,}(/|$)"
GENERIC_MEDIA_NAME = r"(?i)^(video|audio|iframe|embed|player)$"
RTL_LANG = r"^(he|iw|ar)"
TITLE_SEPARATOR = r"\s[|\-–—•]\s"
UNSTABLE_CLASS = r"\d{3,}|^[a-z]{1,2}-\d|^css-|^sc-|^jsx-"

OVERLAY_VENDORS = ["accessibe", "userway", "audioeye", "equalweb", "nagish", "enable.co.il", "accessiway", "maxaccess", "allyable"]
INTERACTIVE_ROLES = (
    "button link checkbox radio switch tab tablist tabpanel menu menuitem menubar combobox listbox option slider "
    "spinbutton dialog alertdialog tree treeitem grid gridcell accordion"
).split()

_B = r"""(?:^|[\s,.;:!?()"'\x{00ab}\x{00bb}\x{2013}\x{2014}-])"""
# kind, pattern; the first that matches a text node wins. "position" needs a look-ahead.
SENSORY = [
    (
        "shape-or-colour",
        r"(?:הכפתור|הקישור|התיבה|הריבוע|העיגול|המשולש|האייקון|הסמל|הכרטיס|השדה|התמונה)\s+"
        r"(?:האדומ?|הירוק|הכחול|הצהוב|הכתום|הסגול|האפור|השחור|הלבן|המרובע|העגול|העליון|התחתון|הימני|השמאלי)",
    ),
    (
        "position",
        _B + r"(?:מימין|משמאל|למעלה|למטה|בפינה|בתחתית|בראש העמוד|בצד ימין|בצד שמאל|בתיבה שמימין|בתיבה שמשמאל)"
        r"(?![^.!?]{0,30}(?:טבלה\s*\d|איור\s*\d|תרשים\s*\d|סעיף\s*\d))",
    ),
    ("colour", _B + r"(?:בצבע\s+\S+|המסומנ(?:ים|ות|ת)?\s+ב(?:אדום|ירוק|כחול|צהוב|כתום)|באדום|בירוק|בכחול)"),
    ("sound", _B + r"(?:המתן|המתינו|חכה|חכו|תשמע|תשמעו)[^.!?]{0,30}(?:צליל|צפצוף|ביפ|קול)"),
    ("sensory-en", r"(?i)\b(?:click|press|see|select|tap)\b[^.!?]{0,30}\b(?:red|green|blue|yellow|round|square|left|right|above|below)\b"),
]
ISLANDS = [("phone", PHONE), ("id-or-number", NINE_DIGITS), ("email", EMAIL), ("reference", REFERENCE_CODE)]

# Component classes compared across pages; the first that matches wins.
COMPONENT_KEYS = [
    ("search", r"חיפוש|חפש|search"),
    ("menu", r"תפריט|menu|נאבורג"),
    ("close", r"סגור|close"),
    ("login", r"כניסה|התחבר|login|sign in"),
    ("register", r"הרשמה|register|sign up"),
    ("cart", r"עגלה|סל|cart|basket"),
    ("contact", r"צור קשר|יצירת קשר|contact"),
    ("accessibility", r"נגישות|accessib"),
    ("skip", r"דלג|skip"),
]

_DATE = r"[^.]{0,60}?(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}|ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר)"
# What an accessibility statement must carry: flag, pattern.
STATEMENT_AUDIT = [
    ("conformance_level", r"(?i)\bAA\b|רמה\s*AA|רמת נגישות|WCAG|5568"),
    ("features_list", r"(אמצעי|התאמות|פעולות)\s*(ה?נגישות)?\s*(ש?בוצעו|באתר)|תומך ב|ניתן לנווט|קורא[יי]? מסך|ניגודיות|טקסט חלופי"),
    ("known_limitations", r"מגבלות\s*נגישות|חלקים שאינם נגישים|טרם הונגש|למרות מאמצינו|אין מגבלות ידועות|לא נמצאו מגבלות"),
    ("coordinator_name", r"""(רכז(?:ת)?\s*(?:ה)?נגישות|ממונה\s*(?:ה)?נגישות)\s*[:\-–]?\s*[\x{0590}-\x{05FF} A-Za-z'"״׳.-]{2,60}"""),
    ("phone", r"0\d{1,2}[-\s]?\d{7}|\+972[-\s]?\d{1,2}[-\s]?\d{7}|\*\d{4}"),
    ("email", EMAIL),
    # The rule joins its labels to the date part by concatenation, so the last label alone carries the date.
    ("audit_date", r"(?i)(ביקורת|בדיקת|סקר)\s*(ה)?נגישות|נבדק" + _DATE),
    ("update_date", r"(?i)(עדכון|עודכן|תאריך)\s*(ה)?(הצהרה|הצהרת נגישות|אחרון)" + _DATE),
]

# Document wording
DOC_SENSORY = (
    r"(?:בטבלה\s+(?:מימין|משמאל|למעלה|למטה)|(?:הכפתור|הקישור|התיבה|הריבוע|העיגול|השדה)\s+(?:האדום|הירוק|הכחול|הצהוב|הכתום)"
    r"|המסומן\s+ב(?:אדום|ירוק|כחול|צהוב)|(?:ראה|ראו|עיין|עיינו)\s+(?:בתרשים|בטבלה|באיור)\s+(?:מימין|משמאל|למעלה|למטה)|בעיגול\s+האדום)"
)
DOC_COMPLEX = r"(?i)(?:תרשים|גרף|דיאגרמה|נוסחה|משוואה|אינפוגרפיק|chart|graph|diagram|formula|equation)"
DOC_FILENAME_ALT = r"(?i)\.(jpe?g|png|gif|svg|webp|emf|wmf)$"
DOC_GENERIC_ALT = r"(?i)^(image|picture|תמונה|graphic)\s*\d*$"
DOC_BULLET = r"^\s*[-–—•*▪◦●·]"
DOC_GENERIC_FILE = r"(?i)^(doc|document|scan|img|file|final|copy|new|untitled|מסמך|סרוק|העתק)[\s_-]*\d*$"
DOC_DEFAULT_SHEET = r"(?i)^(Sheet|גיליון)\s*\d*$"
DOC_NUMBERED_HEADING = r"^\d+(\.\d+)*[.)]?\s+\S"
DOC_TYPED_BULLET = r"^\s*[-–—•*]\s+\S"


def lit(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    if '"' not in pattern:
        return f'r"{pattern}"'
    if "'" not in pattern:
        return f"r'{pattern}'"
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
