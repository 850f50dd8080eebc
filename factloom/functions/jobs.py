"""Facts in job texts as columns: employment, place, pay, languages, skills, experience, visa, section kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.rules import all_matches, case, first_match, once, unless_empty
from factloom.functions.text import JS_SPACE, folded, js, likely, matches

#: The prefectures.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 "
    "愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
#: Patterns of employment types, in texts and (explicit) in titles, and schema.org's names.
EMPLOYMENT = (
    ("permanent", r"正社員|正規社員|permanent\s+employee|full[- ]time"), ("fixed_term", r"契約社員|有期雇用|fixed[- ]term|contract\s+employee"), ("dispatch", r"派遣社員|dispatch\s+worker|temporary\s+staff"),
    ("independent_contractor", r"業務委託|請負|independent\s+contractor|freelance"), ("part_time", r"アルバイト|パート(?!ナー)|part[- ]time"), ("ses_on_site", r"SES常駐|客先常駐"),
)
TITLE_EMPLOYMENT = (
    ("permanent", r"正社員|full[- ]time"), ("fixed_term", r"契約社員|fixed[- ]term|contract employee"), ("dispatch", r"派遣社員|【派遣】|\[dispatch\]"),
    ("independent_contractor", r"業務委託|フリーランス|independent contractor|freelance"), ("part_time", r"アルバイト|パート(?!ナー)|part[- ]time"), ("ses_on_site", r"SES常駐|客先常駐"),
)
SCHEMA_ORG_EMPLOYMENT = (("permanent", "FULL_TIME"), ("part_time", "PART_TIME"), ("independent_contractor", "CONTRACTOR"), ("fixed_term", "TEMPORARY"))
#: Countries by name and city, first match.
COUNTRIES = (
    ("JP", r"\bJP\b|Japan|日本|Tokyo|東京|Fukuoka|福岡|Osaka|大阪|Kanagawa|神奈川|Chiba|千葉|Saitama|埼玉"), ("TW", "Taiwan|Taipei|台湾|台北"), ("KR", "South Korea|Korea|Seoul|韓国|ソウル"),
    ("CN", "China|Beijing|Shanghai|中国|北京|上海"), ("US", "United States|USA|San Francisco|New York|Florida|Washington,? DC|Virginia|California"), ("GB", r"United Kingdom|\bUK\b|London"),
    ("NL", "Netherlands|Amsterdam"), ("VN", "Vietnam|Hồ Chí Minh"), ("TR", "Türkiye|Turkey|Istanbul"), ("BR", "Brazil|São Paulo"), ("SG", "Singapore"), ("TH", "Thailand|Bangkok"),
    ("HK", "Hong Kong"), ("IN", "India|Bangalore|Bengaluru|Gurugram"), ("AU", "Australia|Melbourne|Sydney"), ("DE", "Germany|Berlin|Munich"), ("FR", "France|Paris"),
)
ROMAJI = (("東京都", r"\bTokyo\b"), ("大阪府", r"\bOsaka\b"), ("福岡県", r"\bFukuoka\b"), ("神奈川県", r"\bKanagawa\b"))
#: What marks a place as abroad or in Japan.
ABROAD = r"Taiwan|Taipei|South Korea|Seoul|China|Beijing|Shanghai|United States|USA|San Francisco|New York|United Kingdom|\bUK\b|London|Singapore|India|Bengaluru|Australia|Germany|France|台湾|台北|韓国|ソウル|中国|北京|上海"
IN_JAPAN = r"Japan|日本|\bJP\b|全国|" + "|".join(p if p == "北海道" else p[:-1] for p in PREFECTURES) + "|Tokyo|Osaka|Kyoto|Fukuoka|Hokkaido|Kanagawa|Chiba|Saitama|Aichi|Nagoya|Hyogo|Hiroshima|Sendai|Okinawa"
#: Skills, and phrases of language levels.
SKILLS = (
    ("typescript", r"\bTypeScript\b"), ("javascript", r"\bJavaScript\b"), ("react", r"\bReact\b"), ("next.js", r"\bNext\.?js\b"), ("node.js", r"\bNode\.?js\b"), ("python", r"\bPython\b"), ("java", r"\bJava\b"),
    ("go", r"\bGo(?:lang)?\b"), ("aws", r"\bAWS\b"), ("gcp", r"\bGCP\b"), ("docker", r"\bDocker\b"), ("kubernetes", r"\bKubernetes\b"), ("postgresql", r"\bPostgreSQL\b"), ("ai", r"\bAI\b|人工知能"),
    ("llm", r"\bLLM\b|大規模言語モデル"), ("ios", r"\biOS\b"), ("swift", r"\bSwift\b"), ("unity", r"\bUnity\b"), ("microsoft word", r"Microsoft\s+Word|\bMS\s*Word\b|\bWord\b"),
    ("microsoft excel", r"Microsoft\s+Excel|\bMS\s*Excel\b|\bExcel\b"), ("microsoft powerpoint", r"Microsoft\s+PowerPoint|\bPowerPoint\b"), ("excel vba", r"Excel.{0,12}(?:VBA|マクロ)|\bVBA\b"),
)
LANGUAGES = (
    ("ja", r"(JLPT\s*N[1-5]|日本語.{0,20}(?:ネイティブ|母語|ビジネス|日常会話|N[1-5])|Japanese\s*:?.{0,20}(?:native|business|conversational|N[1-5]))"),
    ("en", r"(TOEIC\s*\d{3,4}|英語.{0,20}(?:ネイティブ|母語|ビジネス|日常会話)|English\s*:?.{0,20}(?:native|business|conversational))"),
    ("zh", r"(中国語.{0,20}(?:ネイティブ|母語|ビジネス|日常会話)|Mandarin|Chinese)"),
)
LEVEL = r"(N[1-5]|\d{3,4}|ネイティブ|母語|ビジネス|日常会話|native|business|conversational)"
#: Experience and visa phrases.
EXPERIENCE = (r"(?:実務経験|開発経験|業務経験|エンジニア経験)[^。\n]{0,24}?(\d{1,2})\s*年(?:以上|超)", r"(?:at\s+least\s+)?(\d{1,2})\+?\s+years?[^.\n]{0,36}(?:experience|professional)")
VISA_YES = r"visa\s+(sponsorship|support)(\s+(is\s+)?available)?|ビザ.{0,12}(支援|サポート)|在留資格.{0,18}(取得|変更|更新).{0,12}(支援|可能)"
VISA_NO = r"no\s+visa\s+(sponsorship|support)|visa\s+(sponsorship|support)\s+(is\s+)?not\s+available|ビザ.{0,12}(支援|サポート).{0,10}(なし|不可)|在留資格.{0,18}(支援不可|対象外)"
DATE_IN_TEXT = r"(\d{4}(?:\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日|[-/.]\d{1,2}[-/.]\d{1,2}(?:[T ][0-9:.+Z-]+)?))"
#: Pay periods and the amounts beside them.
PERIODS = (("year", r"年収|年俸|annual"), ("month", r"月給|基本給|monthly|/\s*month"), ("day", r"日給|daily|/\s*day"), ("hour", r"時給|hourly|/\s*hour"))
_TO, _MAN, _YEN = r"(?:[〜～~\-–—]|から|to)", r"([0-9]{1,4}(?:\.[0-9]+)?)\s*万\s*([0-9]{1,4})?\s*円?", r"[￥¥]?\s*((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{4,9}))\s*円?"
PAY = "struct<kind:string,currency:string,period:string,minimum:decimal(16,2),maximum:decimal(16,2),calculated:boolean>"
#: Section kinds by heading and the text's beginning (label) or heading alone, first match.
SECTIONS = (
    ("other", "heading", r"会社情報|企業情報|company\s+information"), ("employment", "label", r"雇用形態|雇用区分|契約区分|\bemployment\b|type\s+of\s+employment"),
    ("location", "label", r"勤務地|勤務場所|就業場所|住所|アクセス|location|workplace|work\s*location"), ("compensation", "label", r"給与|報酬|年収|月給|時給|日給|salary|compensation|pay\s+range"),
    ("skills", "heading", r"スキル|技術|skills?|technolog"), ("languages", "heading", r"言語|語学|日本語|英語|languages?|JLPT|TOEIC"), ("experience", "heading", r"経験|experience"),
    ("preferred_requirements", "heading", r"歓迎|尚可|preferred|nice\s+to\s+have|歓迎要件"), ("required_requirements", "heading", r"必須|応募資格|応募条件|求める人材|必要条件|requirements?|qualifications?|must\s+have"),
    ("responsibilities", "heading", r"仕事内容|業務内容|職務内容|responsibilit|job\s+description|about\s+the\s+job"),
    ("dates", "label", r"掲載日|掲載開始日|募集開始日|投稿日|更新日|公開日|締切|date\s*(posted|published|modified)|published\s*at|posted\s*at|valid\s*through"),
)


def employment_types(text: Column) -> Column:
    whole = F.upper(F.trim(text))
    named = F.array_compact(F.array(*[F.when(whole == name, v) for v, name in SCHEMA_ORG_EMPLOYMENT]))
    return F.array_distinct(F.concat(named, all_matches(text, EMPLOYMENT)))


def title_employment(title: Column) -> Column:
    return all_matches(title, TITLE_EMPLOYMENT)


def japan_location(text: Column) -> Column:
    """non_japan, japan or unknown."""
    return case((F.coalesce(F.trim(text), F.lit("")) == "", "unknown"), (matches(text, ABROAD) & ~matches(text, r"Japan|日本|\bJP\b"), "non_japan"), (matches(text, IN_JAPAN), "japan"), otherwise="unknown")


def country_code(text: Column) -> Column:
    return F.when(matches(text, "|".join(PREFECTURES)), "JP").otherwise(first_match(text, COUNTRIES))


def prefecture(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), p) for p in PREFECTURES], first_match(text, ROMAJI))


def location(text: Column) -> Column:
    """struct(country, prefecture, city, address, remote_scope), or null if the text is no place."""
    return once(F.trim(F.regexp_replace(text, f"[{JS_SPACE}]+", " ")), _location)


def _location(address: Column) -> Column:
    return once(F.struct(country_code(address).alias("country"), prefecture(address).alias("prefecture")), lambda found: _place(address, found["country"], found["prefecture"]))


def _place(address: Column, country: Column, pref: Column) -> Column:
    after = F.when(F.contains(address, pref), F.substr(address, F.position(pref, address) + F.char_length(pref), F.char_length(address))).otherwise(F.substr(address, F.char_length(pref), F.char_length(address)))
    city = unless_empty(F.regexp_extract(after, js(r"^\s*([^\s,，]{1,20}?(?:市|区|町|村|郡))"), 1))
    fully = matches(address, r"フルリモート|完全在宅|fully\s+remote|remote[- ]first")
    some = fully | matches(address, "リモート|在宅|自宅|telecommute|remote")
    in_japan = (fully & ~matches(address, "worldwide|global|海外|国外")) | matches(address, "国内|日本全国|全国どこでも")
    like_address = matches(address, r"〒?\d{3}-?\d{4}|\d+丁目|\d+番地|\d+-\d+")
    value = F.struct(
        F.coalesce(country, F.when(pref.isNotNull(), "JP")).alias("country"), pref.alias("prefecture"), F.when(pref.isNotNull(), city).alias("city"), address.alias("address"),
        F.when(some & in_japan, "japan").when(some, "unspecified").alias("remote_scope"))
    return F.when((address != "") & (country.isNotNull() | pref.isNotNull() | some | like_address), value)


def _amount(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("decimal(16,2)")


def _man(text: Column, pattern: str, whole: int) -> Column:
    """Ten thousands and the rest."""
    rest = unless_empty(F.regexp_extract(text, js(pattern), whole + 1))
    return (F.regexp_extract(text, js(pattern), whole).try_cast("decimal(16,6)") * 10_000 + F.coalesce(rest.try_cast("decimal(16,2)"), F.lit(0))).cast("decimal(16,2)")


def compensation(text: Column) -> Column:
    """array of struct(kind, currency, period, minimum, maximum, calculated): the first period named with an amount near it."""
    return once(F.regexp_replace(text, f"[{JS_SPACE}]+", " "), _compensation)


def _compensation(compact: Column) -> Column:
    trial = matches(compact, "試用|研修|trial")

    def pay(period: str, low: Column, high: Column) -> Column:
        kind = F.when(trial, "trial").otherwise("total" if period == "year" else "base")
        one = lambda x: F.struct(kind.alias("kind"), F.lit("JPY").alias("currency"), F.lit(period).alias("period"), x["low"].cast("decimal(16,2)").alias("minimum"), x["high"].cast("decimal(16,2)").alias("maximum"), F.lit(False).alias("calculated"))
        return once(F.struct(low.alias("low"), high.alias("high")), lambda x: F.when(x["low"] <= x["high"], F.array(one(x))).otherwise(F.array().cast(f"array<{PAY}>")))

    cases = []
    for period, marker in PERIODS:
        range_man, range_yen, one_man, one_yen = rf"{_MAN}\s*{_TO}\s*{_MAN}", rf"{_YEN}\s*{_TO}\s*{_YEN}", _MAN, r"[￥¥]?\s*([0-9]{2,9}(?:,[0-9]{3})*)\s*円"
        amounts = lambda near: F.coalesce(
            F.when(matches(near, range_man), pay(period, _man(near, range_man, 1), _man(near, range_man, 3))),  # noqa: B023
            F.when(matches(near, range_yen), pay(period, _amount(F.regexp_extract(near, js(range_yen), 1)), _amount(F.regexp_extract(near, js(range_yen), 2)))),  # noqa: B023
            F.when(matches(near, one_man), pay(period, _man(near, one_man, 1), _man(near, one_man, 1))),  # noqa: B023
            F.when(matches(near, one_yen), pay(period, _amount(F.regexp_extract(near, js(one_yen), 1)), _amount(F.regexp_extract(near, js(one_yen), 1)))),  # noqa: B023
        )
        near = F.substring(F.regexp_extract(compact, f"(?s){js('(?:' + marker + ').*')}", 0), 1, 180)
        cases.append(F.when(matches(compact, marker), once(near, amounts)))
    k = r"[￥¥]\s*(\d{2,4})\s*K\s*(?:[〜～~\-]|to)\s*[￥¥]?\s*(\d{2,4})\s*K\s*/\s*Month"
    thousands = lambda i: (F.regexp_extract(compact, js(k), i).try_cast("decimal(16,2)") * 1000).cast("decimal(16,2)")
    return F.coalesce(*cases, F.when(matches(compact, k), pay("month", thousands(1), thousands(2))), F.array().cast(f"array<{PAY}>"))


def annual_maximum(pay: Column) -> Column:
    """A pay's most a year: years as they are, months times twelve, else 0."""
    amount = F.coalesce(pay["maximum"], pay["minimum"], F.lit(0))
    return F.when(pay["period"] == "year", amount).when(pay["period"] == "month", amount * 12).otherwise(0)


def languages(text: Column, requirement: Column) -> Column:
    """array of struct(language, level, requirement)."""
    one = lambda code: lambda m: F.struct(F.lit(code).alias("language"), unless_empty(F.regexp_extract(m, js(LEVEL), 1)).alias("level"), requirement.alias("requirement"))
    each = [F.transform(F.regexp_extract_all(text, F.lit(js(p)), 1), one(code)) for code, p in LANGUAGES]
    return F.array_distinct(F.concat(*each))


def skills(text: Column, requirement: Column) -> Column:
    """array of struct(skill, original, requirement) in the dictionary's order. Patterns are tried only where their plain words stand."""
    one = lambda low, s, p: F.when(likely(low, p) & text.rlike(js(p)), F.struct(F.lit(s).alias("skill"), F.regexp_extract(text, js(p), 0).alias("original"), requirement.alias("requirement")))
    return F.array_compact(once(folded(text), lambda low: F.array(*[one(low, s, p) for s, p in SKILLS])))


def strongest(values: Column, key: str | Callable[[Column], Column]) -> Column:
    """Of an array of structs with a requirement, each key (a field or what a function makes) once, where it first stands, with its strongest requirement."""
    of = key if callable(key) else lambda x: x[key]
    weight = lambda r: F.when(r == "required", 3).when(r == "preferred", 2).otherwise(1)
    keys = F.array_distinct(F.transform(values, of))

    def best(k: Column) -> Column:
        own = F.filter(values, lambda x: of(x) == k)
        most = F.array_max(F.transform(own, lambda x: weight(x["requirement"])))
        return F.get(F.filter(own, lambda x: weight(x["requirement"]) == most), 0)

    return F.transform(keys, best)


def compact_locations(values: Column) -> Column:
    """Without places whose address holds the shorter address of a place that is otherwise the same."""
    same = lambda a, b: a["country"].eqNullSafe(b["country"]) & a["prefecture"].eqNullSafe(b["prefecture"]) & a["city"].eqNullSafe(b["city"]) & a["remote_scope"].eqNullSafe(b["remote_scope"])
    return F.filter(values, lambda v: ~F.exists(values, lambda o: same(o, v) & F.contains(v["address"], o["address"]) & (F.char_length(o["address"]) < F.char_length(v["address"]))))


def experience_years(text: Column) -> Column:
    """Years (1 to 30) of experience that a text asks for."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(js(p)), 1) for p in EXPERIENCE])
    return F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= 1) & (y <= 30)))


def visa_support(text: Column) -> Column:
    """A fact: known, conflicting (a refusal also has the words of an offer), or unknown."""
    values = F.array_compact(F.array(F.when(matches(text, VISA_YES), True), F.when(matches(text, VISA_NO), False)))
    return F.struct(F.when(F.size(values) == 0, "unknown").when(F.size(values) > 1, "conflicting").otherwise("known").alias("state"), values.alias("values"), F.when(F.size(values) == 0, "not_mentioned").alias("unknown_reason"))


def dates_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(DATE_IN_TEXT), 1))


def section_kind(heading: Column, text: Column) -> Column:
    label = F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.substring(text, 1, 120))
    return F.coalesce(*[F.when(matches(heading if of == "heading" else label, p), k) for k, of, p in SECTIONS], F.lit("other"))


def priority(text: Column) -> Column:
    """p0 software and product, p1 consulting and people, p3 care and specified skills, p2 the rest."""
    p0 = r"software|engineer|developer|product|web|AI|machine learning|data|e.?commerce|IT|システム|エンジニア|開発|プロダクト"
    return case((matches(text, p0), "p0"), (matches(text, r"consult|human resources|recruit|talent acquisition|people operations|人事|採用|コンサル"), "p1"), (matches(text, r"介護|特定技能|specified skilled worker"), "p3"), otherwise="p2")


def source_priority(kind: Column) -> Column:
    return F.when(kind.isin("greenhouse", "smartrecruiters", "lever", "ashby", "workday"), 300).when(kind.isin("schema_org", "hrmos", "herp", "jobcan", "airwork", "engage", "talentio"), 200).otherwise(100)


def http_error(status: Column, gone_closes: bool = True) -> Column:
    """struct(code, retryable) of an HTTP status, null for success. Some sources close a record at 404 and 410."""
    code = case((status < 400, None), (status == 403, "forbidden"), (status.isin(404, 410) & F.lit(gone_closes), "record_closed"), (status == 429, "rate_limited"), (status >= 500, "upstream_error"), (status >= 400, "schema_changed"))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), ((status == 429) | (status >= 500)).alias("retryable")))


#: What a safe profile must not hold.
DIRECT_PII = (r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?:\+?81[-\s]?)?0\d{1,4}[-\s]\d{1,4}[-\s]\d{3,4}", r"〒?\d{3}-\d{4}", r"https?://")
#: Industries by words, first match.
INDUSTRIES = (
    ("IT・Web・AI・EC", r"software|engineer|developer|product|web|AI|machine learning|data|e.?commerce|IT|システム|エンジニア|開発|プロダクト"), ("ITコンサル・HR・人事", r"consult|human resources|recruit|talent|人事|採用|コンサル"),
    ("製造", r"製造|工場|機械|電機|自動車|manufactur"), ("金融", r"銀行|証券|保険|金融|financ|bank"), ("小売", r"小売|販売|店舗|retail|store"), ("物流", r"物流|倉庫|配送|運送|logistics"),
    ("ホテル・観光", r"ホテル|宿泊|観光|旅館|hospitality"), ("介護・医療", r"介護|看護|福祉|care|nurs"),
)


def no_direct_pii(text: Column) -> Column:
    """Whether a profile text has no mail address, phone number, postal code or URL."""
    return ~matches(text, "|".join(DIRECT_PII))


def industry(text: Column) -> Column:
    return first_match(text, INDUSTRIES, "その他")


def place_bucket(text: Column) -> Column:
    pref = F.trim(F.regexp_extract(text, "(北海道|東京都|大阪府|京都府|.{2,3}県)", 1))
    return F.when(pref != "", pref).when(matches(text, "Japan remote|日本全国|国内.*リモート|全国.*リモート"), "日本国内リモート").otherwise("日本・都道府県未分類")


def company_status(active_sources: Column, fetched: Column, secure: Column, unsupported: Column, links: Column) -> Column:
    """The end of a company's promotion, first that holds."""
    return case((active_sources > 0, "promoted_active"), (~fetched, "unreachable"), (~secure, "insecure_source"), (unsupported > 0, "unsupported_source"), (links > 0, "unstructured_career_page"), otherwise="verified_no_current_job")


def link_score(url: Column, known_platform: Column) -> Column:
    """How much a link looks like a list of jobs: 1000 on a known platform, else points for and against."""
    text = F.lower(F.concat(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit(""))))
    points = ((r"/(jobs?|positions?|job-offers?)(/|$)", 100), (r"career|recruit|採用|求人|募集", 40), (r"guideline|requirement|recruitment|detail|information", 25),
              (r"contact|entry|interview|message|about|welfare|faq|voice|member|data|environment|privacy|news|blog|twitter|facebook", -60), (r"\.(pdf|jpg|jpeg|png)$", -100))
    total = F.lit(0)
    for pattern, n in points:
        total = total + F.when(text.rlike(pattern), n).otherwise(0)
    return F.when(known_platform, 1000).otherwise(total)


def lane(p0: Column, p1: Column, others: Column) -> Column:
    """The lane of a tenant by its postings of each priority."""
    return F.when((p0 >= p1) & (p0 >= others), "technology").when(p1 >= others, "consultHr").otherwise("other")
