"""URL parts, identifiers and patterns as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.text import col

# Parameter names and host labels that have a meaning of their own.
ID_PARAMS = ["id", "seq", "idx", "no", "num", "key", "code", "post_id", "postid", "board_seq", "boardseq", "article_no", "recruit_id", "recruitid", "job_id", "jobid"]
NON_ID_PARAMS = [
    "page", "pagenum", "pageno", "pagesize", "currentpage", "p", "size", "limit", "offset", "start", "rows", "perpage", "sort", "order", "orderby",
    "dir", "direction", "method", "action", "view", "type", "tab", "lang", "locale", "search", "q", "query", "keyword", "year", "month", "day", "date",
    "menuid", "menu_id", "categoryid", "category_id", "cateid", "cate_id", "tabid", "tab_id", "mid", "nid", "parentid", "parent_id", "groupid",
    "group_id", "roleid", "themeid", "siteid", "site_id", "depth", "lvl", "level", "dobtype",
]
SORT_PARAMS = [
    "sst", "sod", "sfl", "stx", "sca", "page", "pageIndex", "pagenumber", "pageNum", "pageNo", "currentPage", "sort", "order", "orderby", "by", "dir",
    "asc", "desc", "sop", "search_field", "search_str", "scategory", "bo_table", "tab", "category",
]
ID_LIKE_PARAMS = ["wr_id", "idx", "no", "seq", "id", "post", "article", "content_id", "boardId", "post_id", "article_id", "uid", "view_no", "num"]
TWO_LEVEL = [
    "co.kr", "or.kr", "ne.kr", "go.kr", "re.kr", "pe.kr", "ac.kr", "hs.kr", "ms.kr", "es.kr", "sc.kr", "kg.kr", "co.jp", "or.jp", "ne.jp", "ac.jp",
    "go.jp", "co.uk", "ac.uk", "gov.uk", "org.uk", "com.cn", "net.cn", "org.cn", "gov.cn",
]
SKIP_LABELS = ["www", "m", "mobile", "ww", "www2", "recruit", "recruits", "recruiting", "recruitment", "job", "jobs", "career", "careers", "hr", "hiring", "apply", "people"]


def host(x) -> Column:
    return F.lower(F.regexp_extract(col(x), r"^[A-Za-z][\w+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def path(x) -> Column:
    return F.regexp_extract(col(x), r"^[A-Za-z][\w+.\-]*://[^/?#]*([^?#]*)", 1)


def query(x) -> Column:
    return F.regexp_extract(col(x), r"\?([^#]*)", 1)


def segments(x) -> Column:
    return F.filter(F.split(path(x), "/"), lambda s: s != "")


def params(x) -> Column:
    """array of struct name, value in the URL's order; parameters without a value are left out."""
    pairs = F.filter(F.split(query(x), "&"), lambda p: F.regexp_like(p, F.lit("^[^=]*=.")))
    return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))


def external_id(x) -> Column:
    """Last numeric path segment; else an id parameter, one that ends like one, a numeric one; else the last segment, else the URL."""
    parts, pairs = segments(x), params(x)
    first = lambda f: F.try_element_at(F.filter(pairs, f), F.lit(1))["value"]
    name = lambda p: F.lower(p["name"])
    number = lambda v: F.regexp_like(v, F.lit(r"^\d+$"))
    return F.coalesce(
        F.try_element_at(F.filter(parts, number), F.lit(-1)),
        first(lambda p: name(p).isin(ID_PARAMS)),
        first(lambda p: ~name(p).isin(NON_ID_PARAMS) & F.regexp_like(name(p), F.lit("(?:seq|id|no|idx|num|key|code|pk)$"))),
        first(lambda p: ~name(p).isin(NON_ID_PARAMS) & number(p["value"])),
        F.try_element_at(parts, F.lit(-1)),
        F.regexp_replace(col(x), "#.*$", ""),
    )


def site_id(x) -> Column:
    """The host label that names the site: the brand under two-level country domains, else the first label that says something."""
    h = host(x)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    tail = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    country = (n >= 3) & tail.isin(TWO_LEVEL)
    own = F.slice(labels, 1, F.greatest(F.lit(1), F.when(country, n - 2).otherwise(n - 1)))
    named = F.filter(own, lambda p: ~p.isin(SKIP_LABELS))
    kept = F.when(F.size(named) > 0, named).otherwise(own)
    brand = F.when((tail == "go.kr") & (F.size(kept) >= 2), F.element_at(kept, 1)).otherwise(F.element_at(kept, -1))
    # the labels after the leading ones to skip
    lead = F.size(F.filter(own, lambda p, i: F.forall(F.slice(own, F.lit(1), i + 1), lambda q: q.isin(SKIP_LABELS))))
    plain = F.coalesce(F.try_element_at(own, lead + 1), F.element_at(own, -1))
    cafe = F.try_element_at(segments(x), F.lit(1))
    return F.when(h == "", "").when(h.isin("cafe.naver.com", "m.cafe.naver.com") & (cafe != "f-e"), cafe).when(country, brand).otherwise(plain)


def detail_prefix(x) -> Column:
    """The URL up to its last slash."""
    return F.regexp_replace(col(x), "[^/]*$", "")


def registrable(x) -> Column:
    """The last two labels of the host."""
    labels = F.split(host(x), r"\.")
    return F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))


def same_site(a, b) -> Column:
    return registrable(a) == registrable(b)


def sort_or_page_only(x) -> Column:
    """A query of nothing but sorting and paging, on a path that does not end in an id."""
    last = F.regexp_extract(F.regexp_replace(path(x), "/+$", ""), "[^/]*$", 0)
    page = F.regexp_like(last, F.lit(r"\.(?:jsp|php|do|html|htm|asp)$"))
    id_like = F.regexp_like(last, F.lit(r"^\d+$")) | ((F.length(last) >= 8) & F.regexp_like(last, F.lit(r"\d")) & ~page)
    names = F.transform(F.filter(F.split(query(x), "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))
    only = (F.size(names) > 0) & (F.size(F.array_except(names, F.array(*map(F.lit, SORT_PARAMS)))) == 0)
    return F.coalesce((query(x) != "") & ~id_like & ~F.arrays_overlap(names, F.array(*map(F.lit, ID_LIKE_PARAMS))) & only, F.lit(False))


def url_pattern(x) -> Column:
    """Scheme, host and path with numbers as {N} and keyword pages as {KW}."""
    p = F.regexp_replace(path(x), r"\d+", "{N}")
    p = F.regexp_replace(p, r"/[^\x00-\x7F][^/]*\.htm$", "/{KW}.htm")
    p = F.regexp_replace(p, r"/%[A-F0-9]{2}[^/]*\.htm", "/{KW}.htm")
    return F.concat(F.regexp_extract(col(x), r"^[A-Za-z][\w+.\-]*://[^/?#]*", 0), p)


def path_pattern(x) -> Column:
    """The path with each segment as {HEX}, {N} or {ID} where it looks like one."""
    like = lambda s, p: F.regexp_like(s, F.lit(p))
    kind = lambda s: F.when(like(s, "^[a-fA-F0-9]{16,}$"), "{HEX}").when(like(s, r"^\d+$"), "{N}").when(like(s, r"^[A-Za-z0-9._\-]{6,}$"), "{ID}").otherwise(s)
    return F.array_join(F.transform(F.split(path(x), "/"), kind), "/")


def set_query_param(x, name: str, value) -> Column:
    """The URL with one parameter set: in place if it is there, else at the end."""
    url, pair = col(x), F.concat(F.lit(f"{name}="), value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    there = F.regexp_like(url, F.lit(rf"[?&]{name}="))
    joint = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(there, F.regexp_replace(url, F.lit(rf"(?<=[?&]){name}=[^&#]*"), pair)).otherwise(F.concat(url, joint, pair))


def anchor_fingerprint(href) -> Column:
    """The JavaScript function that a link calls, or its URL without query and fragment."""
    name = F.regexp_extract(col(href), r"^javascript:\s*([\w$.]+)\s*\(", 1)
    return F.when(name != "", F.concat(F.lit("js:"), name)).otherwise(F.regexp_replace(col(href), "[?#].*$", ""))


def home_url(x) -> Column:
    """An empty path as /."""
    return F.when(F.regexp_like(col(x), F.lit(r"^[A-Za-z][\w+.\-]*://[^/?#]+$")), F.concat(col(x), F.lit("/"))).otherwise(col(x))


def file_extension(x, default: str = "bin") -> Column:
    found = F.lower(F.regexp_extract(path(x), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(found == "", default).otherwise(found)


def without_dots(p) -> Column:
    """A path with . and .. resolved."""
    parts = F.filter(F.split(col(p), "/"), lambda s: s != ".")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s))))
    joined = F.array_join(kept, "/")
    return F.when(F.regexp_like(col(p), F.lit(r"(?:^|/)\.{1,2}$")) & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)


def absolute(base, href) -> Column:
    """A link as a whole URL against its page's."""
    h, page = F.trim(col(href)), F.regexp_replace(col(base), "[?#].*$", "")
    origin, scheme = F.regexp_extract(col(base), r"^[A-Za-z][\w+.\-]*://[^/?#]*", 0), F.regexp_extract(col(base), r"^[A-Za-z][\w+.\-]*:", 0)
    own, rest = F.regexp_extract(h, "^[^?#]*", 0), F.regexp_extract(h, "[?#].*$", 0)
    folder = F.regexp_replace(F.regexp_replace(page, r"^[A-Za-z][\w+.\-]*://[^/]*", ""), "[^/]*$", "")
    return (
        F.when(F.regexp_like(h, F.lit(r"^[A-Za-z][\w+.\-]*:")), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(origin, without_dots(own), rest))
        .when(F.startswith(h, F.lit("?")), F.concat(page, h)).when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(col(base), "#.*$", ""), h))
        .otherwise(F.concat(origin, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest))
    )


def resolve(base, href) -> Column:
    """A link as a whole URL against its page; null for mail, telephone and mere fragments, for other schemes, and for mere sorting or paging.

    A JavaScript call with a quoted first argument becomes the page's URL with the function and the argument as its query.
    """
    h, page = F.trim(col(href)), F.regexp_replace(col(base), "[?#].*$", "")
    call = r"^(?:javascript:\s*)+([A-Za-z_][\w$]*)\s*\(\s*['\"]([^'\"]+)['\"]"
    called = F.when(F.regexp_like(h, F.lit(call)), F.concat(page, F.lit("?_jsfn="), F.url_encode(F.regexp_extract(h, call, 1)), F.lit("&_jsid="), F.url_encode(F.regexp_extract(h, call, 2))))
    whole = absolute(base, href)
    kept = F.when(F.regexp_like(whole, F.lit("^https?:")) & ~sort_or_page_only(whole), whole)
    return F.when((h == "") | (h == "#") | F.regexp_like(h, F.lit("^(?:mailto|tel):")), None).when(F.startswith(h, F.lit("javascript:")), called).otherwise(kept)


def page_template(x, page: str = "page", size: str = "size") -> Column:
    """The URL with {page} as its page parameter (added if it lacks one) and {size} as its size parameter, if it has one."""
    out = set_query_param(x, page, "{page}")
    return F.regexp_replace(out, rf"(?<=[?&]){size}=[^&#]*", f"{size}={{size}}")


def detail_template(x, known_id) -> Column:
    """The URL with its id as {id}; null where the id is not in it."""
    return F.when((col(known_id) != "") & F.contains(col(x), col(known_id)), F.replace(col(x), col(known_id), F.lit("{id}")))
