"""Parsers and scores on literal pairs."""

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import scores, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [("264억 3,537만원", 264.3537), ("46억 3천만원", 46.3), ("1조 2,000억원", 12000), ("-20억 4천만원", -20.4), ("없음", 0.0), ("", None), (None, None)])
def test_money(spark, raw, want):
    assert value(spark, text.krw_eok(F.lit(raw).cast("string"))) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(("raw", "want"), [("3,600만원", (3600, 3600)), ("5천만원 ~ 1억원", (5000, 10000)), ("1억 5,000만 원", (15000, 15000)), ("월 300만원", (3600, 3600)), ("4,000만원 이상", (4000, None)), ("수당 50만원", (None, None)), (None, (None, None))])
def test_salary(spark, raw, want):
    assert tuple(value(spark, text.salary_range(F.lit(raw).cast("string")))) == want


@pytest.mark.parametrize(("raw", "want"), [("경력 5~16년", (5, 16)), ("경력 3년↑", (3, 100)), ("신입", (0, 0)), ("신입·경력", (0, 100)), ("경력무관", (0, 100)), ("", (None, None))])
def test_years(spark, raw, want):
    assert tuple(value(spark, text.years_range(F.lit(raw)))) == want


@pytest.mark.parametrize(("raw", "want"), [("~ 01/10", "2027-01-10"), ("~ 12/20(일)", "2026-12-20"), ("상시채용", None), ("오늘마감", "2026-12-05"), ("~ 02/30", None)])
def test_due(spark, raw, want):
    found = value(spark, text.due_date(F.lit(raw), "2026-12-05"))
    assert (found and found.isoformat()) == want


@pytest.mark.parametrize(("raw", "want"), [("서울 강남구", 100), ("경기 성남", 50), ("부산", 0), ("역삼", None), (None, None)])
def test_region(spark, raw, want):
    assert value(spark, text.region_score(F.lit(raw).cast("string"))) == want


def test_keys(spark):
    assert value(spark, text.label_key(F.lit("Hugging Face"))) == value(spark, text.label_key(F.lit("HuggingFace")))
    assert value(spark, text.company_key(F.lit("(주)원티드 랩"))) == "원티드랩"
    assert value(spark, text.name_variants(F.lit("와드(캐치테이블)"))) == ["와드", "캐치테이블"]
    for a, b, want in (("ab", "abcdef", False), ("abcdef", "xabcdefy", True), ("", "", False), ("ab", "ab", True)):
        assert value(spark, text.same_title(F.lit(a), F.lit(b))) is want
    assert value(spark, text.clean_title(F.lit("공지 NEW Design 댓글 3개 N"))) == "Design"
    assert value(spark, text.clean_title(F.lit("Design"))) == "Design"
    assert value(spark, text.clean_title(F.lit("Design"), faithful=True)) == "Desig"


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://a.b/view/12345", "12345"), ("https://a.b/x?seq=12345", "12345"), ("https://a.b/x?page=3&recruitSeq=77", "77"), ("https://a.b/list?page=2&z=9", "9"), ("https://a.b/some/name", "name"), ("https://a.b#f", "https://a.b")],
)
def test_external_id(spark, url, want):
    assert value(spark, urls.external_id(F.lit(url))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.career.co.kr", "career"), ("https://job.career.co.kr/jobs/", "career"), ("https://eps.hrdkorea.or.kr", "hrdkorea"), ("https://recruit.kakao.com", "kakao"), ("https://siemreap.korean.net", "siemreap"), ("https://example.com", "example"), ("https://whic.mofa.go.kr", "whic"), ("https://mofa.go.kr", "mofa")],
)
def test_site_id(spark, url, want):
    assert value(spark, urls.site_id(F.lit(url))) == want


def test_url_parts(spark):
    assert value(spark, urls.detail_prefix(F.lit("https://job.career.co.kr/recruit/view/21850667"))) == "https://job.career.co.kr/recruit/view/"
    assert value(spark, urls.set_query_param(F.lit("https://a.b/x?page=1&q=2"), "page", 7)) == "https://a.b/x?page=7&q=2"
    assert value(spark, urls.set_query_param(F.lit("https://a.b/x"), "page", 7)) == "https://a.b/x?page=7"
    assert value(spark, urls.sort_or_page_only(F.lit("https://a.b/list?page=2&sort=x"))) is True
    assert value(spark, urls.sort_or_page_only(F.lit("https://a.b/jobs/6196864?page=2"))) is False
    assert value(spark, urls.path_pattern(F.lit("https://a.b/x/123/abcdef0123456789abcd/y"))) == "/x/{N}/{HEX}/y"
    assert value(spark, urls.home_url(F.lit("https://a.b"))) == "https://a.b/"
    assert value(spark, urls.file_extension(F.lit("https://a.b/c/D.PDF?x"))) == "pdf"


def test_scores(spark):
    for top, want in ((3, 96), (8, 88), (15, 78), (25, 62)):
        assert value(spark, scores.pay_score(F.array(F.lit(f"연봉 상위 {top}%")))) == want
    for revenue, want in ((None, None), (0, 5), (-5, 5), (9, 15), (10, 30), (5000, 100)):
        assert value(spark, scores.revenue_score(F.lit(revenue).cast("double"))) == want
    for high, want in ((3999, 0), (4000, 40), (4400, 75), (4800, 100)):
        assert value(spark, scores.salary_score(F.lit(3000), F.lit(high), F.lit(4000))) == want
    assert value(spark, scores.combined_fit(F.lit(80), F.lit(62))) == 76
    assert value(spark, scores.combined_fit(F.lit(80), F.lit(None).cast("int"))) == 80
    assert [value(spark, scores.histogram_bin(F.lit(x))) for x in (0, 89, 90, 100)] == [0, 8, 9, 9]
    for n, want in ((16, False), (17, True), (900, True), (901, False), (None, True)):
        assert value(spark, scores.size_plausible(F.array(F.lit("51~300명")), F.lit(n).cast("int"))) is want
