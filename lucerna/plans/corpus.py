"""Inputs of the registered queries, derived row by row from the given tables.

The ``pages`` table is regular and nearly free of defects, so defects are added by plain ``replace`` calls
chosen by page id. The same text runs in any SQL engine, which is how results are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucerna.operators.skew import ensure_parallelism

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


END = "</article>"
# (condition, needle, replacement)
EDITS = [
    ("page_id % 7 = 0", '<html lang="en">', "<html>"),
    ("page_id % 7 = 0", '<html lang="fr">', "<html>"),
    ("page_id % 7 = 0", '<html lang="de">', "<html>"),
    ("page_id % 7 = 0", '<html lang="es">', "<html>"),
    ("page_id % 6 = 0", END, '<img src="/a.png" alt="banner.png"><img src="/b.png"><div id="d"></div><div id="d"></div>' + END),
    ("page_id % 3 = 0", "</h1>", "</h1><h3>Sub</h3>"),
    ("page_id % 4 = 0", END, '<a href="/x1">read more</a> <a href="/x2">read more</a>' + END),
    ("page_id % 5 < 2", "<body>", '<body><a href="#m">Skip to content</a>'),
    ("page_id % 5 = 0", "<article>", '<main id="m" tabindex="-1"></main><article>'),
    ("page_id % 11 = 0", "<title>", "<title>Home | Acme</title><title>"),
    ("page_id % 13 = 0", "<nav><ul>", '<nav><ul><li><a href="/about">About</a></li><li><a href="/news">News</a></li>'),
    ("page_id % 13 = 1", "<nav><ul>", '<nav><ul><li><a href="/news">News</a></li><li><a href="/about">About</a></li>'),
    (
        "page_id % 8 = 0",
        END,
        '<form action="/find"><input type="text" name="who" placeholder="Your name"><label for="em">Email *</label>'
        '<input id="em" type="email" required aria-describedby="nope"><select name="s" onchange="go()"><option>a</option></select><button></button></form>' + END,
    ),
    (
        "page_id % 9 = 0",
        END,
        "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table><table><tr><th>h</th></tr><tr><td>x</td></tr></table>" + END,
    ),
    ("page_id % 10 = 0", END, "<marquee>sale</marquee>" + END),
    ("page_id % 10 = 0", "</head>", '<meta http-equiv="refresh" content="5"><meta name="viewport" content="width=device-width, user-scalable=no"></head>'),
    ("page_id % 14 = 0", "</head>", '<script src="https://cdn.userway.org/w.js"></script></head>'),
    (
        "page_id % 15 = 0",
        END,
        '<video src="/v.mp4" autoplay></video><iframe src="https://www.youtube.com/embed/x"></iframe><audio src="/s.mp3" title="Song"></audio>' + END,
    ),
    (
        "page_id % 16 = 0",
        END,
        '<div role="checkbox">x</div><div role="tab" tabindex="0">t</div><div onclick="f()">Go</div><a href="/i"><img src="/i.gif" alt=""></a>' + END,
    ),
    ("page_id % 18 = 0", END, '<span tabindex="3">t</span><div aria-hidden="true"><a href="/h">hidden</a></div><font color="red">f</font>' + END),
    ("page_id % 19 = 0", END, "<p>- one</p><p>- two</p>" + END),
    (
        "page_id % 20 = 0",
        END,
        '<a href="/files/report.pdf">Report</a><a href="https://cdn.other.org/x.docx?utm_source=a">Doc</a><a href="/style.css">Style</a>' + END,
    ),
    ("page_id % 21 = 0", "<footer>", '<footer><a href="/contact">Contact us</a>'),
    ("page_id % 21 = 1", "<footer>", '<footer><a href="/c">Get in contact</a>'),
    ("page_id % 22 = 0", END, '<div class="g-captcha">c</div><div class="carousel"><button>Next</button></div>' + END),
    ("page_id % 25 = 0", END, '<img src="/promo.png" width="600" height="100" alt="Big sale"><div class="error" role="alert">Bad</div>' + END),
]
HEBREW_HEAD = '<!DOCTYPE html><html lang="en"><head><title>דף מספר '
HEBREW_TAIL = (
    '</title></head><body><header><a href="/statement">הצהרת נגישות</a></header><nav><ul><li><a href="/a">אודות החברה</a></li></ul></nav>'
    '<main><h1>שלום לכולם</h1><p>לפרטים נוספים חייגו 03-1234567 בכל שעה.</p><p dir="ltr">טלפון 04-7654321 נוסף</p>'
    '<p>לחצו על הכפתור האדום כדי להמשיך</p><button aria-label="Open the main menu">תפריט</button>'
    "<p>This paragraph is written in English only and it is long enough to count as a passage.</p></main></body></html>"
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _apply(edits, source: str) -> str:
    sql = source
    for i, (cond, needle, new) in enumerate(edits):
        # html appears once per level, so folding the levels into one expression stays linear
        sql = f"SELECT page_id, url, replace(html, {_quoted(needle)}, CASE WHEN {cond} THEN {_quoted(new)} ELSE {_quoted(needle)} END) AS html FROM ({sql}) e{i}"
    return sql


def mutated_sql(source: str = "pages", edits=None) -> str:
    """Pages with defects, plus Hebrew pages and pages that did not load."""
    base = f"SELECT page_id, url, html FROM {source}"
    sql = _apply(EDITS if edits is None else edits, base)
    sql = (
        f"SELECT page_id, url, CASE WHEN page_id % 12 = 5 THEN concat({_quoted(HEBREW_HEAD)}, cast(page_id as string), {_quoted(HEBREW_TAIL)}) ELSE html END AS html FROM ({sql}) h"
    )
    return f"SELECT page_id, url, CASE WHEN page_id % 17 = 3 THEN NULL ELSE html END AS html FROM ({sql}) l"


# the later review: heading and link defects repaired, language lost elsewhere, some pages gone and some new
LATER_EDITS = [e for e in EDITS if e[0] not in ("page_id % 3 = 0", "page_id % 4 = 0")] + [
    ("page_id % 19 = 1", '<html lang="en">', "<html>"),
    ("page_id % 9 = 2", "</h1>", "</h1><h4>Deep</h4>"),
]


def later_sql(source: str = "pages") -> str:
    return f"SELECT page_id, url, html FROM ({mutated_sql(source, LATER_EDITS)}) x WHERE page_id % 23 <> 4"


def earlier_sql(source: str = "pages") -> str:
    return f"SELECT page_id, url, html FROM ({mutated_sql(source)}) x WHERE page_id % 23 <> 5"


def derive(spark: SparkSession, sf_dir: str, sql: str, **tables: str) -> DataFrame:
    """Run derivation SQL with its source tables bound as temp views of this session.

    Pages are dealt out before they are edited: the edits cost far more than the reading, and a row group is one task.
    """
    for name in tables.values():
        source = table(spark, sf_dir, name)
        source = ensure_parallelism(source, "page_id") if name == "pages" else source
        source.createOrReplaceTempView(f"lucerna_src_{name}")
    return spark.sql(sql)


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, mutated_sql("lucerna_src_pages"), p="pages")


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, earlier_sql("lucerna_src_pages"), p="pages")


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, later_sql("lucerna_src_pages"), p="pages")


STATEMENT_HTML = (
    "<!DOCTYPE html><html lang=\"he\" dir=\"rtl\"><head><title>הצהרת נגישות</title></head><body><main><h1>הצהרת נגישות</h1><p>האתר עומד ברמה AA של התקן 5568. פירוט אמצעי הנגישות באתר מופיע כאן, ניתן לנווט במקלדת.</p>"
    "<p>רכז נגישות: ישראל ישראלי, טלפון 03-1234567.</p><p>תאריך ההצהרה 01/02/2024.</p></main></body></html>"
)


def with_statements_sql(source: str = "pages") -> str:
    """The pages with defects plus, for every Hebrew page, the statement page it links to."""
    return (
        f"SELECT page_id, url, html FROM ({mutated_sql(source)}) a UNION ALL SELECT page_id + 10000000 AS page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/statement') AS url,"
        f" {_quoted(STATEMENT_HTML)} AS html FROM {source} WHERE page_id % 12 = 5"
    )


def with_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, with_statements_sql("lucerna_src_pages"), p="pages")
