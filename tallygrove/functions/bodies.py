"""HTML bodies of JSON answers: which fields a body shows, under which headings, as lists of (heading, Column) over one parsed answer.

A field that is missing, null or empty shows nothing, a table without rows and a section without text are left out, and a number of zero counts as empty where a
heading says how many. Values are escaped, but for sections whose fields hold HTML. An answer that is no JSON has a body without fields.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.text import escape_html

Rows = Sequence[tuple[str, Column]]

# The markup of a section of plain text, the salary units by code, and the headings and field names below.
PLAIN = "<pre style='white-space:pre-wrap;font-family:inherit'>"
SALARY_UNITS = {1: "/시", 2: "/일", 3: "/주", 4: "/월", 5: "/년"}


def escaped(x: Column) -> Column:
    """Text for use in HTML, quotation marks included."""
    return F.replace(F.replace(escape_html(x), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def field(answer: Column, path: str) -> Column:
    """The text at a path; null if there is none."""
    return F.nullif(F.try_variant_get(answer, f"$.{path}", "string"), F.lit(""))


def number(answer: Column, path: str) -> Column:
    """The whole number at a path; null if there is none, or zero."""
    return F.nullif(F.try_variant_get(answer, f"$.{path}", "long"), F.lit(0))


def label(answer: Column, path: str) -> Column:
    """What the object at a path is called: its label, else its name."""
    return F.nullif(F.trim(F.coalesce(field(answer, f"{path}.label"), field(answer, f"{path}.name"))), F.lit(""))


def labels(answer: Column, path: str, each: Callable[[Column], Column]) -> Column:
    """each of the list at a path, nulls left out, joined by commas."""
    found = F.transform(F.try_variant_get(answer, f"$.{path}", "array<variant>"), each)
    return F.nullif(F.array_join(found, ", "), F.lit(""))


def truth(answer: Column, path: str, shown: str) -> Column:
    """shown if the field at a path is true, or a number but zero."""
    return F.when(F.coalesce(F.try_variant_get(answer, f"$.{path}", "boolean"), F.lit(False)), shown)


def table(rows: Rows) -> Column:
    """A table of the rows that have a value; null if none has."""
    cells = [F.concat(F.lit(f"<tr><th>{name}</th><td>"), escaped(value), F.lit("</td></tr>")) for name, value in rows]
    return F.concat(F.lit("<table>"), F.nullif(F.concat_ws("", *cells), F.lit("")), F.lit("</table>"))


def section(heading: str, text: Column) -> Column:
    """A heading and what stands under it, if that is anything."""
    return F.concat(F.lit(f"<h3>{heading}</h3>\n"), text)


def plain(text: Column) -> Column:
    return F.concat(F.lit(PLAIN), escaped(text), F.lit("</pre>"))


def labelled_body(a: Column) -> Column:
    """Body of an answer whose choices are objects with a label."""
    day = lambda *paths: F.coalesce(escaped(F.left(F.coalesce(*[field(a, p) for p in paths]), F.lit(10))), F.lit(""))
    dates = F.concat(F.lit("<p><b>Publish Date:</b> "), day("pubdate"), F.lit("  <b>Closing Date:</b> "), day("expdate", "closeDate"), F.lit("</p>"))
    ages = [F.coalesce(number(a, p), F.lit(0)) for p in ("ageFrom", "ageTo")]
    offer = [
        ("Level", label(a, "jobLevelId")), ("Term", label(a, "termId")), ("Year of Exp", F.nullif(field(a, "workyears"), F.lit("0"))), ("Function", label(a, "categoryId")),
        ("Hiring", F.nullif(field(a, "hirelings"), F.lit("0"))), ("Industry", label(a, "industrialId")), ("Salary", label(a, "salaryId")), ("Qualification", label(a, "qualificationId")), ("Sex", label(a, "sex")),
        ("Language", labels(a, "jobLangs", lambda x: F.when(label(x, "languageId").isNotNull(), F.concat_ws(" — ", label(x, "languageId"), label(x, "languageLevelId"))))),
        ("Age", F.when(ages[0] + ages[1] > 0, F.concat_ws("–", *ages)).otherwise("Age Unlimited")), ("Location", labels(a, "locations", lambda x: label(x, "locationId"))),
        ("Address", field(a, "address")), ("Major", field(a, "major")),
    ]
    email = F.coalesce(field(a, "contact.email"), F.when(truth(a, "showEmail", "").isNotNull(), field(a, "employer.email")))
    contact = [("Company", field(a, "employer.company")), ("Company Address", field(a, "employer.address")), ("Contact", field(a, "contact.name")), ("Email", email), ("Phone", field(a, "contact.telephone"))]
    texts = [("Job Description", "description"), ("Job Requirements", "requirement"), ("Others Benefit", "employer.welfare")]
    return F.concat_ws("\n", F.when(F.coalesce(*[field(a, p) for p in ("pubdate", "expdate", "closeDate")]).isNotNull(), dates), table(offer), *[section(h, plain(field(a, p))) for h, p in texts], section("Contact", table(contact)))


def marked_up_body(a: Column) -> Column:
    """Body of an answer with a job and a company, whose longer fields hold HTML."""
    grouped = lambda x: F.format_number(x, 0)
    least, most = number(a, "job.min_salary"), number(a, "job.max_salary")
    amounts = F.when(least != most, F.concat_ws(" ~ ", grouped(least), grouped(most))).otherwise(grouped(F.coalesce(least, most)))
    unit = F.create_map(*[F.lit(x) for pair in SALARY_UNITS.items() for x in pair])[number(a, "job.salary_unit").cast("int")]
    salary = F.concat(F.coalesce(field(a, "job.salary_currency"), F.lit("")), F.lit(" "), amounts, F.coalesce(unit, F.lit("")))
    offer = [
        ("게시일", F.left(field(a, "job.ad_start"), F.lit(10))), ("마감일", field(a, "job.perioid_end")), ("위치", field(a, "job.address")), ("급여", salary),
        ("경력", F.concat(number(a, "job.experience_year").cast("string"), F.lit("년 이상"))), ("비자 스폰", truth(a, "job.sponsor_visa", "가능")), ("인턴십", truth(a, "job.internship", "가능")),
        ("재택근무", truth(a, "job.remote_work", "가능")), ("태그", field(a, "job.tag")),
    ]
    where = F.when(field(a, "company.address").isNotNull(), F.concat_ws(" ", *[field(a, f"company.{p}") for p in ("address", "city", "country")]))
    company = [("회사명", field(a, "company.name")), ("업종", field(a, "company.industry")), ("규모", field(a, "company.size")), ("주소", where), ("전화", field(a, "company.phone")), ("홈페이지", field(a, "company.website"))]
    texts = [("공고 내용", "content"), ("주요 업무", "task"), ("자격 요건", "requirement"), ("우대 사항", "give_preference"), ("복리 후생", "welfare")]
    about = F.coalesce(field(a, "company.about_us"), field(a, "company.about_us_line"))
    mail = F.concat(F.lit("<p><b>지원 이메일:</b> "), escaped(field(a, "job.alram_email")), F.lit("</p>"))
    sections = [F.concat(section(h, field(a, f"job.{p}")), F.lit("\n")) for h, p in texts]
    return F.concat_ws("\n", table(offer), *sections, section("회사 정보", F.nullif(F.concat_ws("\n", table(company), about), F.lit(""))), mail)


def rendered(answers: DataFrame, json_col: str, bodies: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """answers with a column for each of bodies (name to labelled_body, marked_up_body or one's own); every text is parsed once."""
    parsed = "parsed"
    while parsed in answers.columns:
        parsed += "_"
    return answers.withColumn(parsed, F.try_parse_json(json_col)).withColumns({name: body(F.col(parsed)) for name, body in bodies.items()}).drop(parsed)
