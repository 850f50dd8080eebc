"""The parser from raw versions to facts with evidence: the golden corpus, fixtures of every form, quotes by span."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import parsing
from factloom.sources import html

#: The kinds of source, and the variants of employment and place of the golden corpus.
KINDS = "greenhouse schema_org manual hrmos herp jobcan airwork engage talentio smartrecruiters lever ashby workday".split()
VARIANTS = (
    ("tokyo-permanent", "正社員", "permanent", "東京都渋谷区", "東京都"), ("niigata-permanent", "正社員", "permanent", "新潟県燕市吉田下中野1535番地5", "新潟県"), ("osaka-permanent", "正規社員", "permanent", "大阪府大阪市北区", "大阪府"),
    ("fukuoka-permanent", "FULL_TIME", "permanent", "福岡県福岡市博多区", "福岡県"), ("hokkaido-permanent", "正社員", "permanent", "北海道札幌市中央区", "北海道"), ("kanagawa-fixed", "契約社員", "fixed_term", "神奈川県横浜市西区", "神奈川県"),
    ("kyoto-fixed", "有期雇用", "fixed_term", "京都府京都市中京区", "京都府"), ("remote-japan", "正社員", "permanent", "日本国内フルリモート", None),
)


def parsed(spark, *versions):
    rows = [(i, kind, "https://fixture.invalid/1", raw if isinstance(raw, str) else json.dumps(raw, ensure_ascii=False)) for i, (kind, raw) in enumerate(versions)]
    out = parsing.parse_versions(spark.createDataFrame(rows, "id int, source_kind string, source_url string, raw string"))
    return out.withColumn("misquoted", parsing.misquoted(out)).orderBy("id").collect()


def one(spark, kind, raw):
    row, = parsed(spark, (kind, raw))
    assert row.misquoted == [] and row.status == "succeeded"
    return row


def test_golden_corpus(spark):
    cases = [(k, v) for k in KINDS for v in VARIANTS]
    payload = lambda k, v: {"title": f"業務改善スペシャリスト {k} {v[0]}", "employmentType": v[1], "location": {"name": v[3]}, "salary": "月給22万円〜25万円", "requirements": "必須: Microsoft Word、Microsoft Excel、日本語JLPT N2", "description": "業務プロセスの改善、資料作成、関係者との調整を担当します。"}
    rows = parsed(spark, *[(k, payload(k, v)) for k, v in cases])
    assert len(rows) == 104
    right = told = 0
    for r, (_, v) in zip(rows, cases, strict=True):
        assert r.status == "succeeded" and r.misquoted == []
        told += (r.employment_types.state != "unknown") + (r.locations.state != "unknown")
        right += r.employment_types.state == "known" and v[2] in r.employment_types["values"]
        right += r.locations.state == "known" and any(p.remote_scope == "japan" if v[4] is None else (p.country, p.prefecture) == ("JP", v[4]) for p in r.locations["values"])
        pay, = r.compensation["values"]
        assert (r.compensation.state, pay.period, int(pay.minimum), int(pay.maximum)) == ("known", "month", 220_000, 250_000)
        assert r.skills.state == r.languages.state == "known" and {s.skill for s in r.skills["values"]} == {"microsoft word", "microsoft excel"}
    assert right / told >= 0.99 and right / (2 * len(cases)) >= 0.95


def test_visible_html(spark):
    r = one(spark, "airwork", "<html><body><main><h1>【正社員】工具メーカーの事務スタッフ</h1><section><h2>求める人材</h2><div><h3>スキル</h3><span>Microsoft Word</span><span>Microsoft Excel</span></div></section>"
            "<section><h2>勤務地</h2><dl><dt>住所</dt><dd>〒959-0215 新潟県燕市吉田下中野1535番地5</dd></dl></section><section><h2>給与</h2><p>月給 22万円 〜 25万円</p></section></main></body></html>")  # fmt: skip
    assert r.employment_types["values"] == ["permanent"]
    assert [(p.country, p.prefecture, p.city) for p in r.locations["values"]] == [("JP", "新潟県", "燕市")] or ("JP", "新潟県", "燕市") in [(p.country, p.prefecture, p.city) for p in r.locations["values"]]
    assert {s.skill for s in r.skills["values"]} >= {"microsoft word", "microsoft excel"}
    assert [(p.period, int(p.minimum), int(p.maximum)) for p in r.compensation["values"]] == [("month", 220_000, 250_000)]
    assert {e.quote for e in r.evidence if e.field == "employment_types"} == {"【正社員】"}


def test_many_facts_and_contradictory_visa(spark):
    r = one(spark, "greenhouse", {"title": "27卒 Web / AI Engineer", "location": {"name": "Tokyo (Remote/Hybrid)"}, "content": "<p>雇用形態: 正社員 または 契約社員</p><p>応募要件: JLPT N1、TypeScript、React、Node.js、AI、Web開発経験3年以上</p>"
            "<p>Visa sponsorship is available. No visa sponsorship for this employment track.</p><p>年収 400万円〜600万円</p>"})  # fmt: skip
    assert r.employment_types["values"] == ["permanent", "fixed_term"]
    assert (r.visa_support.state, r.visa_support["values"]) == ("conflicting", [True, False])
    assert r.locations.state == r.languages.state == r.compensation.state == "known"
    assert [v.years for v in r.experience["values"]] == [3]
    assert {e.field for e in r.evidence} >= {"title", "employment_types", "visa_support", "locations", "languages", "skills", "compensation", "experience"}
    assert all(e.source_url == "https://fixture.invalid/1" and e.rule and e.ordinal is not None for e in r.evidence)


def test_dates(spark):
    posting = {"@type": "JobPosting", "title": "Web Engineer", "datePosted": "2026-07-01", "validThrough": "2026-09-30T23:59:59+09:00", "employmentType": "FULL_TIME", "description": "<p>正社員 / Python / 日本語ビジネス</p>", "jobLocation": {"address": {"addressRegion": "東京都", "addressCountry": "JP"}}}
    r = one(spark, "greenhouse", f'<script type="application/ld+json">{json.dumps(posting)}</script>')
    value = lambda f: [(d.value, d.precision) for d in f["values"]]
    assert value(r.published) == [("2026-07-01", "date")] and value(r.valid_through) == [("2026-09-30T14:59:59.000Z", "datetime")] and r.title == "Web Engineer"
    r = one(spark, "greenhouse", "<html><body><main><h1>バックエンドエンジニア</h1><section><h2>掲載日</h2><p>掲載開始日：2026年7月7日</p></section><section><h2>勤務地</h2><p>東京都</p></section><section><h2>雇用形態</h2><p>正社員</p></section></main></body></html>")
    assert (r.published.state, value(r.published)) == ("known", [("2026-07-07", "date")])
    r = one(spark, "greenhouse", {"title": "Product Engineer", "content": "<p>Full-time product engineering role based in Tokyo with TypeScript.</p>", "datePosted": "2026-07-01", "publishedAt": "2026-07-02T09:00:00+09:00", "dateModified": "not-a-date"})
    assert r.published.state == "conflicting" and [p for _, p in value(r.published)] == ["date", "datetime"] and (r.source_updated.state, r.source_updated["values"]) == ("unknown", [])
    r = one(spark, "greenhouse", {"id": 123, "title": "Platform Engineer", "location": {"name": "Tokyo, Japan"}, "content": "Full-time platform engineering role in Tokyo.", "first_published": "2026-07-01T12:34:56Z", "updated_at": "2026-07-12T01:02:03Z", "application_deadline": "2026-08-31T23:59:59Z"})
    assert [value(x) for x in (r.published, r.source_updated, r.valid_through)] == [[("2026-07-01T12:34:56.000Z", "datetime")], [("2026-07-12T01:02:03.000Z", "datetime")], [("2026-08-31T23:59:59.000Z", "datetime")]]


def test_places_abroad_at_home_and_by_full_name(spark):
    abroad = one(spark, "greenhouse", {"title": "Backend Engineer", "location": {"name": "Taipei, Taiwan"}, "content": "<p>Full-time backend engineering role.</p>"})
    assert [p.country for p in abroad.locations["values"]] == ["TW"]
    home = one(spark, "herp", {"title": "Remote Product Engineer", "location": {"name": "＜勤務地＞ ご自宅などインターネットに接続可能な場所"}, "employmentType": "正社員", "description": "プロダクト開発を担当します。"})
    assert any(p.remote_scope == "unspecified" for p in home.locations["values"])
    smart = one(spark, "smartrecruiters", {"id": "744000000000001", "name": "IT Consultant", "releasedDate": "2026-07-14T08:29:20.852Z", "location": {"city": "Tokyo", "country": "jp", "fullLocation": "Tokyo, Japan"}, "typeOfEmployment": {"id": "permanent", "label": "Full-time"}, "jobAd": {"sections": {"jobDescription": {"text": "<p>雇用形態: 正社員。IT consulting with Japanese N1.</p>"}}}})
    assert any(p.country == "JP" for p in smart.locations["values"]) and smart.employment_types.state == "known" and smart.published["values"][0].value == "2026-07-14T08:29:20.852Z"


def test_detail_page_and_client_rendered_page(spark):
    r = one(spark, "hrmos", "<html><head><title>採用情報</title></head><body><main><h1>人事・採用担当</h1><section><h2>仕事内容</h2><p>採用計画、候補者対応、入社手続きを担当します。</p><h2>応募条件</h2><p>雇用形態：正社員。人事の実務経験3年以上。日本語N1。</p></section></main></body></html>")
    assert r.title == "人事・採用担当" and r.employment_types.state == r.languages.state == "known" and r.visa_support.unknown_reason == "not_mentioned" and [v.years for v in r.experience["values"]] == [3]
    props = json.dumps({"recruitmentOpenPage": {"name": "Process Engineer", "requisitionDetails": [{"name": "Qualifications", "value": "At least 5 years of experience. English business level. Japanese N2 or above."}, {"name": "Salary", "value": "￥400K- ￥540K/Month"}, {"name": "Location", "value": ["東京都江東区"]}, {"name": "Employment", "value": "正社員"}], "jobDescriptionDetails": []}})
    r = one(spark, "talentio", f"<html><head><title>Process Engineer</title></head><body><div data-react-props='{props}'></div></body></html>")
    assert r.employment_types.state == r.locations.state == r.languages.state == r.compensation.state == "known"
    assert {(v.language, v.level) for v in r.languages["values"]} == {("en", "business"), ("ja", "N2")} and [v.years for v in r.experience["values"]] == [5]


def test_no_document_has_no_facts(spark):
    rows = parsed(spark, ("lever", "{not json"), ("lever", {"description": "no title"}), ("lever", ""), ("hrmos", "<body></body>"), ("lever", {"title": "short"}))
    assert all(r.status == "failed" and len(r.errors) == 1 and r.evidence == [] and r.employment_types is None and r.description is None for r in rows)


def test_unknown_reasons(spark):
    r = one(spark, "lever", {"title": "Something to do", "employmentType": "お問い合わせください", "salary": "応相談", "location": "未定です", "skills": "やる気", "description": "とくになし。とくになし。とくになし。"})
    assert [(f, r[f].unknown_reason) for f in ("employment_types", "locations", "skills", "compensation", "languages", "experience", "published", "visa_support")] == [
        ("employment_types", "not_parsed"), ("locations", "not_parsed"), ("skills", "not_parsed"), ("compensation", "unsupported_format"), ("languages", "not_mentioned"), ("experience", "not_mentioned"), ("published", "not_mentioned"), ("visa_support", "not_mentioned")]


def test_strongest_requirement_and_sections(spark):
    r = one(spark, "lever", {"title": "Engineer of things", "requirements": "Python, AWS and Japanese N1. 実務経験 3年以上", "preferredQualifications": "Python, Docker, 日本語 N1, 実務経験 5年以上", "description": "Kubernetes in a plain description"})
    assert {(s.skill, s.requirement) for s in r.skills["values"]} == {("python", "required"), ("aws", "required"), ("docker", "preferred")}
    assert {(v.language, v.level, v.requirement) for v in r.languages["values"]} == {("ja", "N1", "required")}
    assert {(v.years, v.requirement) for v in r.experience["values"]} == {(3, "required"), (5, "preferred")}
    assert len([e for e in r.evidence if e.field == "skills"]) == 4  # evidence is kept for what a stronger requirement replaces


def test_section_order_and_hidden_headings():
    page = "<body><main><h1>A page of several forms</h1><dl><dt>給与</dt><dd>月給22万円</dd></dl><section><header><h2>必須</h2></header><p>plain words here</p></section><div><h3>スキル</h3>Python</div><ul class=job-summary><li>勤務地 東京都</li><li>nothing</li></ul><section><h2>勤務地</h2>大阪府</section></main></body>"
    found = html.document(page, "hrmos").sections
    assert [(s["kind"], s["heading"]) for s in found] == [("title", "title"), ("other", None), ("location", "勤務地"), ("skills", "スキル"), ("compensation", "給与"), ("location", None)]
    assert [s["ordinal"] for s in found] == list(range(6))


@pytest.mark.parametrize("most", [7, 10, 50])
def test_chunks_cover_the_text(most):
    for text in ("a" * 33, "ab\ncd\n\nefghij\nk" * 5, "\n" * 30 + "x", "x y\n z  \nlonger line here\n"):
        parts = html.chunks(text, most)
        assert all(text[a:b] == t and t == t.strip() and 0 < len(t) <= most for t, a, b in parts) or len(text) <= most
        assert "".join(t for t, _, _ in parts).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")


def test_columns_are_kept_and_nulls_borne(spark):
    rows = [(None, None, None, None, "own"), (1, "lever", None, json.dumps({"title": "An engineer at work", "description": "Full-time work in Tokyo"}), "own")]
    df = spark.createDataFrame(rows, "id int, source_kind string, source_url string, raw string, title string").withColumn("extra", F.lit(3))
    out = parsing.parse_versions(df).orderBy("id").collect()
    assert [r.status for r in out] == ["failed", "succeeded"] and [r.extra for r in out] == [3, 3] and out[1].employment_types["values"] == ["permanent"]
    assert parsing.parse_versions(df.where("false")).count() == 0
