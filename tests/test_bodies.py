"""Bodies rendered from JSON answers."""

import json

from tallygrove.functions import bodies


def render(spark, *answers):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, x in enumerate(answers)]
    df = spark.createDataFrame(rows, "id int, parsed string")  # clashes with the working column
    return bodies.rendered(df, "parsed", {"one": bodies.labelled_body, "two": bodies.marked_up_body}).orderBy("id").collect()


def test_labelled_body(spark):
    full = {
        "pubdate": "2024-05-01T10:00", "closeDate": "2024-06-01", "jobLevelId": {"label": " Senior "}, "termId": {"name": "Full"}, "workyears": 0, "hirelings": 2, "sex": "any", "ageTo": 40,
        "jobLangs": [{"languageId": {"label": "Khmer"}, "languageLevelId": {"label": "good"}}, {"languageId": {"name": "Thai"}}, {}, 3], "locations": [{"locationId": {"label": "A&B"}}],
        "description": "x < \"y's\"", "employer": {"company": "C", "email": "e@c", "welfare": ""}, "showEmail": True,
    }
    row = lambda k, v: f"<tr><th>{k}</th><td>{v}</td></tr>"
    offer = row("Level", "Senior") + row("Term", "Full") + row("Hiring", 2) + row("Language", "Khmer — good, Thai") + row("Age", "0–40") + row("Location", "A&amp;B")
    want = ["<p><b>Publish Date:</b> 2024-05-01  <b>Closing Date:</b> 2024-06-01</p>", f"<table>{offer}</table>", "<h3>Job Description</h3>", f"{bodies.PLAIN}x &lt; &quot;y&#x27;s&quot;</pre>", "<h3>Contact</h3>", f"<table>{row('Company', 'C') + row('Email', 'e@c')}</table>"]
    bare = f"<table>{row('Age', 'Age Unlimited')}</table>"
    assert [r["one"] for r in render(spark, full, {}, None, "{broken", [1])] == ["\n".join(want), bare, bare, bare, bare]


def test_marked_up_body(spark):
    full = {
        "job": {"ad_start": "2024-05-01 10:00", "min_salary": 1000000, "max_salary": 2500000, "salary_unit": 4, "salary_currency": "KRW", "experience_year": 3, "internship": 1, "remote_work": False, "content": "<p>a & b</p>", "alram_email": "<m>"},
        "company": {"name": "C", "address": "1 Road", "country": "KR", "about_us_line": "<i>us</i>"},
    }
    row = lambda k, v: f"<tr><th>{k}</th><td>{v}</td></tr>"
    offer = row("게시일", "2024-05-01") + row("급여", "KRW 1,000,000 ~ 2,500,000/월") + row("경력", "3년 이상") + row("인턴십", "가능")
    want = [f"<table>{offer}</table>", "<h3>공고 내용</h3>", "<p>a & b</p>", "", "<h3>회사 정보</h3>", f"<table>{row('회사명', 'C') + row('주소', '1 Road KR')}</table>", "<i>us</i>", "<p><b>지원 이메일:</b> &lt;m&gt;</p>"]
    one = {"job": {"max_salary": 5, "min_salary": 5}}
    found = [r["two"] for r in render(spark, full, one, {"job": 7, "company": {}}, None, "")]
    assert found == ["\n".join(want), f"<table>{row('급여', ' 5')}</table>", "", "", ""]
    assert bodies.rendered(spark.createDataFrame([], "j string"), "j", {"one": bodies.labelled_body}).count() == 0


def test_bodies_are_rendered_by_many_tasks(spark, sf):
    """One small file of rows is not left to one task."""
    from tallygrove.plans import upkeep_queries

    assert upkeep_queries.rendered_bodies(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
