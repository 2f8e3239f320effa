"""Predicates, states and labels of postings, runs and pages as Columns; the present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.text import col

# Words that tell titles of job posts, of events, and short menu labels.
JOB_WORDS = [
    "채용", "모집", "공고", "구인", "구직", "채용공고", "구인구직", "입사", "취업", "일자리", "리쿠르팅", "리크루팅", "사원", "직원", "인턴", "신입", "경력", "정규직", "계약직",
    "아르바이트", "알바", "강사", "연구원", "매니저", "팀장", "선임", "수석", "대리", "과장", "차장", "부장", "담당자", "책임자",
    "hiring", "recruit", "position", "opening", "vacancy", "intern", "manager", "engineer", "developer", "designer", "executive", "officer", "specialist", "analyst", "supervisor",
    "assistant", "coordinator", "consultant", "programmer", "sales", "marketing", "finance", "accountant", "technician", "operator", "associate", "lead", "head", "chief", "staff",
    "director", "administrator",
]
EVENT_WORDS = [
    "설명회", "박람회", "세미나", "강연", "강의", "특강", "워크숍", "워크샵", "토론회", "컨퍼런스", "심포지엄", "포럼", "행사", "교육과정", "교육안내", "교육일정", "수강", "안내", "프로그램 안내",
    "seminar", "webinar", "workshop", "conference", "symposium", "info session", "briefing", "fair", "expo",
]
MENU_WORDS = ["구인구직", "구인", "구직", "채용공고", "채용정보", "채용", "모집공고", "career", "careers", "recruit", "recruiting", "recruitment", r"\bjobs?\b", "hiring", "vacancies"]
# What URLs of single posts look like.
DETAIL_URLS = [r"-show-\d+", r"/view/\d+", r"/detail/\d+", r"\bview\.do\b", r"\.do\?[^=]*[Ss]eq=\d", r"_no=\d", r"\?id=\d{4,}", r"/post/\d+", r"/article/\d+", r"/p/\d+"]
# Provinces of area codes, and their names for the whole country and for other codes.
AREAS, OTHER_AREA = {"I": "서울", "B": "경기", "K": "인천", "R": "해외"}, "지방"
# Navigation that pages leave behind the body.
TRAILING_NAVIGATION = [
    "이전글", "다음글", "목록", r"이전\s*글", r"다음\s*글", r"prev\s*post", r"next\s*post", "댓글목록", "comments?", "share", "좋아요", "추천", r"SNS\s*공유", "관련자료",
    r"등록된\s*댓글이?\s*없습니다\.?", r"로그인한?\s*회원만\s*댓글\s*등록이?\s*가능합니다\.?", r"이전\s+[^|]+?\s*작성일\s*\d{4}[\.\-]\d{1,2}[\.\-]\d{1,2}[^|]*?",
    r"다음\s+[^|]+?\s*작성일\s*\d{4}[\.\-]\d{1,2}[\.\-]\d{1,2}[^|]*?", r"댓글\s*\d+", "×",
]
WEEKDAYS = "월화수목금토일"


def any_word(x, words: list[str]) -> Column:
    """Whether one of the words (patterns) occurs, in any case; false for null."""
    return F.coalesce(F.regexp_like(col(x), F.lit("(?iu)" + "|".join(words))), F.lit(False))


def is_job_title(x) -> Column:
    return any_word(x, JOB_WORDS)


def is_event(x) -> Column:
    return any_word(x, EVENT_WORDS)


def is_detail_url(x) -> Column:
    return F.coalesce(F.regexp_like(col(x), F.lit("|".join(DETAIL_URLS))), F.lit(False))


def overridden_label(label, text, longest: int = 20) -> Column:
    """An unknown label of a short menu text with a telling word is filtered."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    return F.when((col(label) == "unknown") & F.length(t).between(1, longest) & any_word(t, MENU_WORDS), "filtered").otherwise(col(label))


def menu_wanted(kind, name, include: str, exclude: str, board: str = "B") -> Column:
    t = F.trim(F.coalesce(col(name), F.lit("")))
    return F.coalesce((col(kind) == board) & (t != "") & ~F.regexp_like(t, F.lit(exclude)) & F.regexp_like(t, F.lit(include)), F.lit(False))


def is_expired(due, source, last_seen, as_of: str, searched: list[str], stale_days: int = 30) -> Column:
    """Past its due date, or without one and not seen for stale_days by a source that only searches."""
    now = F.to_timestamp(F.lit(as_of))
    unseen = col(due).isNull() & col(source).isin(searched) & (col(last_seen) < now - F.make_interval(days=F.lit(stale_days)))
    return F.coalesce((F.to_date(col(due)) < F.to_date(now)) | unseen, F.lit(False))


def needs_refit(fit, seen_hash, current: str, due, as_of: str, least: int) -> Column:
    """High enough, judged under another profile, and not due today or before."""
    open_ = col(due).isNull() | (F.to_date(col(due)) > F.to_date(F.lit(as_of)))
    return F.coalesce((col(fit) >= least) & (F.coalesce(col(seen_hash), F.lit("")) != current) & open_, F.lit(False))


def stuck_reason(failures, images, most: int = 3) -> Column:
    return F.when(F.coalesce(col(failures), F.lit(0)) >= most, "unreadable").when(F.coalesce(col(images), F.lit(0)) == 0, "no_content").otherwise("too_little_text")


def run_state(started, progress, finished, failed, alive, as_of: str, stall_minutes: int = 15) -> Column:
    """not_today, failed, done, stalled or running, in this order."""
    now = F.to_timestamp(F.lit(as_of))
    idle = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(col(progress), col(started)).cast("timestamp")) > 60 * stall_minutes
    return (
        F.when(col(started).isNull() | (F.to_date(col(started)) != F.to_date(now)), "not_today").when(col(failed), "failed").when(col(finished), "done")
        .when(~col(alive) | idle, "stalled").otherwise("running")
    )


def step_failed(errors, processed) -> Column:
    return (col(errors) > 0) & (col(processed) == 0)


def is_empty_detail(body, *media, shortest: int = 50) -> Column:
    """A body of fewer characters than shortest and no medium of any kind (counts)."""
    out = F.length(F.coalesce(col(body), F.lit(""))) < shortest
    for m in media:
        out = out & (F.coalesce(col(m), F.lit(0)) == 0)
    return out


def assembled(sections: dict[str, Column], body) -> Column:
    """Sections under their names where the first two have any text, else the body."""
    first = list(sections.values())[:2]
    some = F.coalesce(first[0] != "", F.lit(False)) | F.coalesce(first[1] != "", F.lit(False))
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in sections.items()]
    return F.when(some, F.concat_ws("\n", *parts)).otherwise(F.coalesce(col(body), F.lit("")))


def without_trailing_navigation(x) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), r"(?i)(\s*(" + "|".join(TRAILING_NAVIGATION) + r")\s*)+$", ""), r"\s+$", "")


def career_years(kind, years) -> Column:
    """struct lo, hi of a career type and its years."""
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    some = F.when(col(years) < 100, col(years)).otherwise(1)
    return F.when(col(kind) == "1", pair(F.lit(0), F.lit(0))).when(col(kind) == "2", pair(some, F.lit(100))).when(col(kind).isin("3", "4"), pair(F.lit(0), F.lit(100))).otherwise(pair(F.lit(None), F.lit(None)))


def years_label(lo, hi) -> Column:
    text = lambda c: col(c).cast("string")
    open_ = F.when(col(lo) == 0, "경력무관").otherwise(F.concat(F.lit("경력 "), text(lo), F.lit("년↑")))
    from_new = F.when(col(hi) == 0, "신입").otherwise(F.concat(F.lit("신입~"), text(hi), F.lit("년")))
    return F.when(col(lo).isNull(), "").when(col(hi) == 100, open_).when(col(lo) == 0, from_new).otherwise(F.concat(F.lit("경력 "), text(lo), F.lit("~"), text(hi), F.lit("년")))


def area_label(code, places) -> Column:
    """Province of an area code and the first two of the places (separated by commas); null if there is nothing to say."""
    first = F.substring(F.coalesce(col(code), F.lit("")), 1, 1)
    known = F.create_map(*[F.lit(x) for pair in AREAS.items() for x in pair])
    province = F.when(F.regexp_like(first, F.lit(r"^\p{L}$")) & (first != "Q"), F.coalesce(F.get(F.array(F.try_element_at(known, first)), F.lit(0)), F.lit(OTHER_AREA)))
    some = F.array_join(F.slice(F.split(F.coalesce(col(places), F.lit("")), ","), 1, 2), " ")
    return F.nullif(F.concat_ws(" ", province, F.nullif(some, F.lit(""))), F.lit(""))


def clean_due(x, far: str = "2060") -> Column:
    """The date part of a due text; null from far on, which stands for none."""
    t = F.substring(col(x), 1, 10)
    return F.when(t < far, t)


def duration_label(minutes) -> Column:
    m = col(minutes).cast("long")
    rest = F.concat((m % 60).cast("string"), F.lit("분"))
    return F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit("시간 "), rest)).otherwise(rest)


def day_label(x) -> Column:
    name = F.substring(F.lit(WEEKDAYS), F.weekday(col(x)) + 1, F.lit(1))
    return F.concat(F.date_format(col(x), "MM/dd"), F.lit(" ("), name, F.lit(")"))


def progress_bar(ratio, width: int = 10) -> Column:
    n = F.bround(col(ratio) * width).cast("int")
    return F.concat(F.repeat(F.lit("▓"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def page_numbers(current, pages) -> Column:
    """First and last page and two on either side of the current one (from 0), in order; none for a single page."""
    around = F.concat(F.array(F.lit(0), col(pages) - 1), F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: col(current) + i))
    return F.when(col(pages) > 1, F.array_sort(F.array_distinct(F.filter(around, lambda p: (p >= 0) & (p < col(pages)))))).otherwise(F.array().cast("array<int>"))


def page_title(html, suffix: str = "", longest: int = 80) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " ")
    return F.nullif(F.substring(F.regexp_replace(t, suffix, "") if suffix else t, 1, longest), F.lit(""))


def scan_html(html, pattern: str, most: int = 20) -> Column:
    """The first distinct matches of a pattern's group in raw HTML, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(col(html), F.lit(pattern), F.lit(1))), 1, most)


def first_number(x, paths: list[str]) -> Column:
    """The first of several JSON paths that holds a number."""
    return F.coalesce(*[F.get_json_object(col(x), p).try_cast("bigint") for p in paths])


def answered(answer, url, labels: list[str]) -> Column:
    """struct label, reason that a model's JSON answer has for a URL, the last if several; unknown for other labels, no entry, or malformed text.

    An answer is a list of entries, an object that holds such a list, a single entry, or an object of entries by URL.
    """
    entry = "url string, label string, reason string"
    t = F.ltrim(F.coalesce(col(answer), F.lit("")))
    fields = F.from_json(F.when(F.startswith(t, F.lit("{")), t), "map<string,string>")
    several = lambda x: F.from_json(x, f"array<struct<{entry}>>")
    held = F.get(F.filter(F.map_values(fields), lambda v: F.startswith(v, F.lit("["))), F.lit(0))

    def by_url(pair):
        inner = F.from_json(pair["value"], entry)
        return F.struct(F.coalesce(inner["url"], pair["key"]).alias("url"), inner["label"].alias("label"), inner["reason"].alias("reason"))

    single = F.map_contains_key(fields, F.lit("url")) & F.map_contains_key(fields, F.lit("label"))
    keyed = F.forall(F.map_values(fields), lambda v: F.startswith(v, F.lit("{")))
    entries = F.when(F.startswith(t, F.lit("[")), several(t)).when(held.isNotNull(), several(held)).when(single, F.array(F.from_json(t, entry))).when(keyed, F.transform(F.map_entries(fields), by_url))
    last = F.try_element_at(F.filter(entries, lambda e: e["url"] == col(url)), F.lit(-1))
    label = F.when(last["label"].isin(labels), last["label"]).otherwise("unknown")
    return F.struct(label.alias("label"), F.coalesce(last["reason"], F.lit("")).alias("reason"))
