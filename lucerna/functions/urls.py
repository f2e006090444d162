"""URL operators (U1-U7, U22, U27-U29) as SQL expression builders over a string column."""

from __future__ import annotations

import hashlib

# Query keys that never change a page, document and ignored extensions, two-label suffixes.
TRACKING = (
    r"(?i)^utm_|^ga_|^_ga$|^gclid$|^gbraid$|^wbraid$|^dclid$|^fbclid$|^msclkid$|^mc_(cid|eid)$|^igshid$|^ref$|^referrer$|^source$|^campaign|^yclid$|^_openstat$"
)
DOCUMENT_EXTENSIONS = {
    ".pdf": "pdf", ".doc": "docx", ".docx": "docx", ".docm": "docx", ".rtf": "docx", ".ppt": "pptx", ".pptx": "pptx", ".ppsx": "pptx",
    ".xls": "xlsx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".csv": "txt", ".txt": "txt",
}
IGNORED_EXTENSIONS = (
    ".jpg .jpeg .png .gif .webp .avif .svg .ico .bmp .tiff .mp3 .mp4 .wav .ogg .webm .avi .mov .m4a .m4v .zip .rar .7z .gz .tar .exe .dmg "
    ".msi .apk .css .js .mjs .map .json .xml .rss .atom .woff .woff2 .ttf .otf .eot"
).split()
TWO_LABEL_SUFFIXES = "co.il org.il net.il ac.il gov.il muni.il k12.il idf.il co.uk org.uk ac.uk com.au co.nz com.br".split()

_PARTS = r"r'^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$'"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {_PARTS}, 1))"


def authority(u: str) -> str:
    return f"regexp_extract({u}, {_PARTS}, 2)"


def host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({authority(u)}, r'^.*@', ''), r':\\d*$', ''))".replace("\\\\", "\\")


def port(u: str) -> str:
    return rf"regexp_extract({authority(u)}, r':(\d+)$', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, {_PARTS}, 3)"


def query(u: str) -> str:
    return f"substring(regexp_extract({u}, {_PARTS}, 4), 2)"


def origin(u: str) -> str:
    return f"concat({scheme(u)}, '://', lower({authority(u)}))"


def _escape_path(p: str) -> str:
    keep = r"c rlike r'^[!-~]$' and c not in ('\"', '<', '>', '`', '{', '}', '^', ' ')"
    return f"if({p} rlike r'[^!-~]|[\"<>`{{}}^]', array_join(transform(split({p}, ''), c -> if({keep} or c = '', c, replace(url_encode(c), '+', '%20'))), ''), {p})"


def _dots(p: str) -> str:
    """Resolve . and .. segments, only where a path has any."""
    seg = f"filter(split({p}, '/'), (s, i) -> i > 0)"
    folded = (
        f"concat('/', array_join(aggregate({seg}, cast(array() as array<string>), (acc, s) -> case when s = '..' then slice(acc, 1, greatest(size(acc) - 1, 0))"
        f" when s = '.' then acc else concat(acc, array(s)) end), '/'), if({p} rlike r'/[.][.]?$', '/', ''))"
    )
    return f"if({p} rlike r'/[.][.]?(/|$)', regexp_replace({folded}, '^//', '/'), {p})"


def params(q: str) -> str:
    """Decoded (key, value, pos) triples of a query string."""
    decode = "coalesce(try_url_decode({x}), replace({x}, '+', ' '))"
    return (
        f"transform(filter(split({q}, '&'), s -> s <> ''), (s, i) -> named_struct('key', {decode.format(x='split_part(s, ' + repr('=') + ', 1)')}, 'pos', i,"
        f" 'value', {decode.format(x='if(instr(s, ' + repr('=') + ') = 0, ' + repr('') + ', substring(s, instr(s, ' + repr('=') + ') + 1))')}))"
    )


def kept_params(q: str) -> str:
    """Tracking keys dropped, the rest ordered by key; equal keys keep their order."""
    return f"array_sort(filter({params(q)}, p -> not p.key rlike r'{TRACKING}'))"


def canonicalize(u: str) -> str:
    """The key under which a URL is deduplicated; NULL for anything that is not http(s)."""
    bare_port = f"if({port(u)} = '' or ({scheme(u)} = 'https' and {port(u)} = '443') or ({scheme(u)} = 'http' and {port(u)} = '80'), '', concat(':', {port(u)}))"
    user = rf"regexp_extract({authority(u)}, r'^(.*@)', 1)"
    raw = f"if({path(u)} = '', '/', {path(u)})"
    clean = f"get(transform(array({_dots(_escape_path(raw))}), p -> if(p <> '/', regexp_replace(p, r'/+$', ''), p)), 0)"
    folded = rf"regexp_replace({clean}, r'(?i)/(index|default)[.](html?|php|aspx?)$', '/')"
    qs = f"array_join(transform({kept_params(query(u))}, p -> concat(url_encode(p.key), '=', url_encode(p.value))), '&')"
    return (
        f"if({scheme(u)} in ('http', 'https') and {host(u)} <> '', concat({scheme(u)}, '://', {user}, {host(u)}, {bare_port},"
        f" coalesce(nullif({folded}, ''), '/'), if({qs} = '', '', concat('?', {qs}))), null)"
    )


def resolve(href: str, base: str) -> str:
    """An href against the page it sits on. Other schemes come back as they are."""
    h = f"trim({href})"
    folder = rf"regexp_replace(if({path(base)} = '', '/', {path(base)}), r'[^/]*$', '')"
    return (
        f"case when {h} rlike r'^[a-zA-Z][a-zA-Z0-9+.-]*:' then {h} when {h} like '//%' then concat({scheme(base)}, ':', {h})"
        f" when {h} like '/%' then concat({origin(base)}, {h}) when {h} = '' then regexp_replace({base}, r'#.*$', '')"
        f" when {h} like '#%' then concat(regexp_replace({base}, r'#.*$', ''), {h}) when {h} like '?%' then concat({origin(base)}, {path(base)}, {h})"
        f" else concat({origin(base)}, {folder}, {h}) end"
    )


def extension(p: str) -> str:
    """Extension of the last path segment, lower case, '' when none."""
    return rf"lower(regexp_extract(element_at(split({p}, '/'), -1), r'([.][^.]*)$', 1))"


def doc_type(u: str) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in DOCUMENT_EXTENSIONS.items())
    return f"map({pairs})[{extension(path(u))}]"


def link_kind(u: str) -> str:
    """U4: page, document or ignore."""
    return (
        f"case when {u} is null or {scheme(u)} = '' then 'ignore' when {doc_type(u)} is not null then 'document'"
        f" when {extension(path(u))} in {_in(IGNORED_EXTENSIONS)} then 'ignore' else 'page' end"
    )


def registrable_domain(h: str) -> str:
    """Last two labels, or three under a known two-label suffix."""
    labels = f"split(regexp_replace(lower({h}), r'[.]$', ''), r'[.]')"
    two = f"array_join(slice({labels}, -2, 2), '.')"
    return f"if(size({labels}) <= 2, array_join({labels}, '.'), if({two} in {_in(TWO_LABEL_SUFFIXES)}, array_join(slice({labels}, -3, 3), '.'), {two}))"


def in_scope(u: str, start: str, include: str = "cast(null as array<string>)", exclude: str = "cast(null as array<string>)") -> str:
    """Exclude wins; a non-empty include list replaces the same-site test."""
    return (
        f"(not coalesce(exists({exclude}, p -> {u} rlike p), false) and if(coalesce(size({include}), 0) > 0,"
        f" exists({include}, p -> {u} rlike p), {registrable_domain(host(u))} = {registrable_domain(host(start))}))"
    )


def slug(u: str, limit: int = 80, dots: bool = False) -> str:
    """File-safe name of a URL. The remediation variant also folds dots and is shorter."""
    keep, fold = (r"[^\p{L}\p{N}\-_/.]+", r"[/.]+") if dots else (r"[^\p{L}\p{N}\-_/]+", r"/+")
    pq = f"concat({path(u)}, regexp_extract({u}, {_PARTS}, 4))"
    s = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({pq}, r'{keep}', '-'), r'{fold}', '-'), r'-+', '-'), r'^-|-$', '')"
    return f"left(coalesce(nullif({s}, ''), 'home'), {limit})"


def strip_html(h: str) -> str:
    """Markup to text."""
    s = rf"regexp_replace(regexp_replace(regexp_replace({h}, r'(?is)<script.*?</script>', ' '), r'(?is)<style.*?</style>', ' '), r'<[^>]+>', ' ')"
    s = f"replace(replace(replace({s}, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"')"
    s = (
        rf"if({s} rlike r'&#\d+;', array_join(transform(split({s}, r'(?=&#\d+;)|(?<=&#\d{{1,7}};)'), t -> if(t rlike r'^&#\d{{1,7}};$',"
        rf" decode(unhex(lpad(hex(cast(regexp_extract(t, r'(\d+)', 1) as bigint)), 8, '0')), 'UTF-32'), t)), ''), {s})"
    )
    return rf"trim(regexp_replace({s}, r'[\s\x{{00a0}}]+', ' '))"


def shape_guard(u: str) -> str:
    """Why a URL is refused before any lookup, NULL when its shape is fine.

    A host that is an address in any spelling is judged as one; a dot at the end does not make it another host.
    """
    from lucerna.operators.policy import literal_reason

    bare = rf"regexp_replace({host(u)}, r'^\[|\]$|[.]$', '')"
    return (
        f"case when {scheme(u)} = '' then 'invalid' when {scheme(u)} not in ('http', 'https') then 'scheme' when instr({authority(u)}, '@') > 0 then 'userinfo'"
        rf" when {bare} = 'localhost' or {bare} rlike r'[.]local(host)?$' then 'local-host' else {literal_reason(bare)} end"
    )


def normalise_domain(raw: str) -> str:
    """Host part of user input, NULL when it cannot be a host name."""
    h = rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({raw})), r'^https?://', ''), r'/.*$', ''), r':\d+$', '')"
    return rf"if({raw} is null or {raw} = '' or char_length({raw}) > 253 or not {h} rlike r'^[a-z0-9.-]+$' or instr({h}, '.') = 0 or {h} like '-%', null, {h})"


def hmac_pads(secret: str) -> tuple[str, str]:
    """Inner and outer key pads as hex; the secret never enters a plan in clear."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def ownership_token(domain: str, account: str, secret: str) -> str:
    """First 32 hex digits of HMAC-SHA256 over ``domain:account``, all in built-in functions."""
    inner, outer = hmac_pads(secret)
    msg = f"encode(concat(lower({domain}), ':', {account}), 'UTF-8')"
    return f"left(sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), {msg}), 256))), 256), 32)"
