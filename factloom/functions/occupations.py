"""Occupations of job titles by an ordered rule list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.rules import all_matches, matched_numbers, once
from factloom.functions.text import matches

VERSION = "occupation-taxonomy-v1"
#: Families in order.
FAMILIES = (
    "sales_customer_success planning_marketing_management corporate_management office_administration it_web_software creative_design_media engineering_research architecture_construction_facilities "
    "retail_service_hospitality professional_consulting_finance_real_estate medical_healthcare welfare_care childcare_education manufacturing_maintenance_skilled logistics_transport_warehouse public_organizations security_cleaning_agriculture other"
).split()
#: Family, role and pattern of each rule, specific occupations before broad terms.
RULES = (
    ("childcare_education", "academic_affairs_school_operations", r"教務(?:事務|担当)?|学校運営|学校法人職員|大学事務|学校事務|academic affairs|school operations"),
    ("childcare_education", "student_support_career", r"学生支援|就職支援|キャリア支援|student affairs|career services"),
    ("childcare_education", "childcare_kindergarten", r"保育士|幼稚園教諭|保育教諭|childcare|kindergarten"),
    ("childcare_education", "teacher_lecturer_instructor", r"教師|教員|講師|インストラクター|trainer|teacher|lecturer"),
    ("corporate_management", "human_resources_recruiting", r"人事|労務|採用(?:担当|広報|責任者|マネージャー|マネジャー|リーダー|コーディネーター|業務)|中途採用|recruiter|talent acquisition|human resources|people operations|\bHRBP\b|\bHR (?:manager|specialist|operations)"),
    ("corporate_management", "accounting_finance", r"経理|財務|会計|accounting|accountant|finance controller|bookkeep|treasurer"),
    ("corporate_management", "legal_compliance", r"企業法務|法務(?:担当|ジェネラリスト|スペシャリスト|マネージャー)?|コンプライアンス|IT統制|知的財産|知財|in-house legal|compliance"),
    ("corporate_management", "general_affairs", r"総務|庶務管理|general affairs"),
    ("corporate_management", "procurement_supply_chain", r"購買|調達|サプライチェーン|\bSCM\b|procurement|sourcing"),
    ("corporate_management", "internal_audit_ir", r"内部監査|内部統制|\bIR\b|investor relations|internal audit"),
    ("office_administration", "trade_international_office", r"貿易事務|海外事務|国際事務|輸出入事務|trade operations|import.?export"),
    ("office_administration", "medical_office", r"医療事務|調剤.*事務|介護事務|medical (?:office|clerk)"),
    ("office_administration", "sales_office_assistant", r"営業事務|営業アシスタント|sales (?:assistant|administrator|coordinator)"),
    ("office_administration", "reception_secretary", r"受付|秘書|receptionist|secretary|executive assistant"),
    ("office_administration", "data_entry_operations", r"データ入力|事務オペレーター|入力オペレーター|data entry"),
    ("office_administration", "general_office_administration", r"一般事務|事務職|事務スタッフ|事務員|オフィスワーク|administrative assistant|office administrator|office clerk|back.?office assistant"),
    ("professional_consulting_finance_real_estate", "interpreter_translator", r"通訳|翻訳|ローカライズ|interpreter|translator|localization specialist"),
    ("sales_customer_success", "technical_sales", r"技術営業|システム営業|セールスエンジニア|プリセールス|solutions? engineer|pre.?sales"),
    ("sales_customer_success", "customer_success_support", r"カスタマーサクセス|カスタマーサポート|カスタマーサービス|customer success|customer support|client success"),
    ("sales_customer_success", "recruitment_consultant", r"人材コーディネーター|キャリアアドバイザー|キャリアカウンセラー|recruitment consultant"),
    ("sales_customer_success", "inside_sales", r"インサイドセールス|内勤営業|inside sales"),
    ("sales_customer_success", "account_management", r"アカウントマネージャー|既存営業|ルートセールス|account manager|account executive"),
    ("sales_customer_success", "personal_sales", r"個人営業|リテール営業|住宅営業|personal sales|retail sales consultant"),
    ("sales_customer_success", "corporate_sales", r"法人営業|企画営業|海外営業|ソリューション営業|business development|corporate sales|enterprise sales"),
    ("sales_customer_success", "sales_management", r"営業企画|営業推進|営業管理|sales operations|sales manager"),
    ("creative_design_media", "game_creative", r"ゲームプランナー|ゲームデザイナー|レベルデザイナー|game planner|game designer|technical artist"),
    ("creative_design_media", "ui_ux_web_designer", r"UI.?UX|Webデザイナー|ウェブデザイナー|product designer|interaction designer"),
    ("creative_design_media", "graphic_cg_designer", r"グラフィックデザイナー|CGデザイナー|イラストレーター|graphic designer|3D artist|2D artist"),
    ("creative_design_media", "content_editor_writer", r"編集|校正|ライター|コピーライター|コンテンツ制作|editor|writer|copywriter|content creator"),
    ("creative_design_media", "video_audio_production", r"映像制作|動画制作|音響|撮影|フォトグラファー|video producer|videographer|sound designer"),
    ("creative_design_media", "industrial_spatial_design", r"プロダクトデザイナー|工業デザイン|空間デザイン|インテリアデザイナー|industrial designer|spatial designer"),
    ("it_web_software", "game_engineer", r"ゲーム.*(?:エンジニア|プログラマ)|(?:game|Unity|Unreal).*(?:engineer|developer|programmer)|クライアントエンジニア"),
    ("it_web_software", "mobile_app_engineer", r"iOS|Android|Swift|Kotlin|Flutter|React Native|モバイルアプリ|スマホアプリ|mobile (?:app )?(?:engineer|developer)"),
    ("it_web_software", "data_ai_ml_engineer", r"AIエンジニア|機械学習|データサイエンティスト|データエンジニア|ML engineer|machine learning|data scientist|data (?:platform |infrastructure |analytics )?engineer|computer vision|NLP engineer"),
    ("it_web_software", "frontend_engineer", r"フロントエンド|frontend|front-end"),
    ("it_web_software", "backend_engineer", r"バックエンド|backend|back-end|server-side engineer"),
    ("it_web_software", "fullstack_engineer", r"フルスタック|full.?stack"),
    ("it_web_software", "infrastructure_cloud_sre", r"インフラ(?:ストラクチャ)?エンジニア|クラウドインフラ|クラウドエンジニア|\bSRE\b|DevOps|platform engineer|cloud (?:infrastructure )?engineer"),
    ("it_web_software", "network_telecom_engineer", r"ネットワークエンジニア|通信エンジニア|network engineer|telecom engineer"),
    ("it_web_software", "security_engineer", r"セキュリティエンジニア|SOC analyst|security engineer|cyber.?security"),
    ("it_web_software", "qa_test_engineer", r"QAエンジニア|テストエンジニア|品質保証.*ソフト|\bQA(?: engineer| lead| manager)?\b|quality assurance engineer|test engineer"),
    ("it_web_software", "internal_it_support", r"社内SE|情報システム|情シス|ITサポート|ヘルプデスク|corporate IT|IT support|help.?desk"),
    ("it_web_software", "embedded_control_engineer", r"組み込み|組込み|制御系|ファームウェア|embedded|firmware"),
    ("it_web_software", "pm_pdm_it_consulting", r"プロダクトマネージャ[ー―]|プロジェクトマネージャ[ー―]|プロジェクトリーダー|ITコンサル|システムコンサル|\bPdM\b|\bPjM\b|\bPMO\b|project lead|program manager|delivery manager|technical program manager|IT consultant"),
    ("it_web_software", "general_software_engineer", r"システムエンジニア|ソフトウェアエンジニア|ITエンジニア|Webエンジニア|開発エンジニア|プログラマ|software engineer|software developer|web developer"),
    ("planning_marketing_management", "marketing_growth", r"マーケティング|広告運用|販促|グロース|SEO|SEM|organic search|marketing|growth"),
    ("planning_marketing_management", "product_service_planning", r"商品企画|サービス企画|プロダクト企画|事業開発|product planning|service planning"),
    ("planning_marketing_management", "business_planning_strategy", r"経営企画|事業企画|戦略企画|business planning|corporate strategy"),
    ("planning_marketing_management", "pr_communications", r"広報|PR担当|\bPR manager|head of communications|communications manager|public relations"),
    ("planning_marketing_management", "executive_management", r"代表取締役|執行役員|事業責任者|ゼネラルマネージャー|chief .* officer|country manager|general manager"),
    ("professional_consulting_finance_real_estate", "management_consultant", r"経営コンサル|戦略コンサル|業務コンサル|コンサルタント|management consultant|strategy consultant|consulting"),
    ("professional_consulting_finance_real_estate", "licensed_legal_accounting_professional", r"弁護士|弁理士|司法書士|行政書士|公認会計士|税理士|社会保険労務士|attorney|lawyer|CPA"),
    ("professional_consulting_finance_real_estate", "finance_investment_insurance", r"銀行|証券|保険|投資|融資|アクチュアリー|トレーダー|ファンドマネージャー|investment|underwriter|actuary"),
    ("professional_consulting_finance_real_estate", "real_estate_professional", r"不動産|用地仕入|プロパティマネージャー|real estate|property manager"),
    ("medical_healthcare", "nurse_midwife_public_health", r"看護師|准看護師|保健師|助産師|nurse|midwife"),
    ("medical_healthcare", "doctor_dentist_veterinarian", r"医師|歯科医師|獣医師|doctor|dentist|veterinarian"),
    ("medical_healthcare", "pharmacist", r"薬剤師|pharmacist"),
    ("medical_healthcare", "medical_technologist_therapist", r"理学療法士|作業療法士|言語聴覚士|臨床検査技師|診療放射線技師|therapist|medical technologist"),
    ("medical_healthcare", "clinical_research_regulatory", r"臨床開発|治験|薬事|clinical research|clinical development|regulatory affairs"),
    ("welfare_care", "care_management", r"ケアマネ|施設長|介護.*管理|care manager"),
    ("welfare_care", "social_worker_support", r"社会福祉士|生活相談員|生活支援員|ソーシャルワーカー|social worker"),
    ("welfare_care", "care_worker", r"介護職|介護福祉士|ヘルパー|care worker|caregiver"),
    ("architecture_construction_facilities", "construction_management", r"施工管理|工事監理|construction manager|site manager"),
    ("architecture_construction_facilities", "architecture_design", r"建築設計|意匠設計|構造設計|architect"),
    ("architecture_construction_facilities", "civil_engineering", r"土木設計|橋梁設計|測量|積算|地質調査|civil engineer|surveyor"),
    ("architecture_construction_facilities", "facilities_plant_engineering", r"設備設計|プラントエンジニア|電気工事|管工事|facility engineer|plant engineer"),
    ("engineering_research", "electrical_electronics_semiconductor", r"電気設計|電子回路|半導体|回路設計|electrical engineer|electronics engineer|semiconductor"),
    ("engineering_research", "mechanical_engineering", r"機械設計|機構設計|メカトロ|mechanical engineer"),
    ("engineering_research", "chemical_materials_engineering", r"化学研究|素材開発|材料開発|chemical engineer|materials engineer"),
    ("engineering_research", "food_biotech_engineering", r"食品開発|バイオ研究|生物研究|food scientist|biotech"),
    ("engineering_research", "quality_production_engineering", r"生産技術|品質管理|品質保証|プロセスエンジニア|process engineer|production engineer|quality control"),
    ("engineering_research", "research_development", r"研究員|研究開発|基礎研究|応用研究|R&D|researcher"),
    ("retail_service_hospitality", "hotel_travel_leisure", r"ホテル|旅館|旅行|観光|添乗員|hotel|travel|tourism"),
    ("retail_service_hospitality", "food_service", r"調理師|調理スタッフ|ホールスタッフ|飲食店|シェフ|cook|chef|restaurant staff"),
    ("retail_service_hospitality", "beauty_wellness", r"美容師|エステティシャン|ネイリスト|セラピスト|beautician|esthetician"),
    ("retail_service_hospitality", "retail_store_operations", r"販売スタッフ|店舗スタッフ|店長|小売|retail|store manager"),
    ("retail_service_hospitality", "general_customer_service", r"接客|サービススタッフ|customer service associate"),
    ("logistics_transport_warehouse", "driver_delivery", r"ドライバー|運転手|配送|配達|delivery driver|delivery associate|courier|\bdriver\b"),
    ("logistics_transport_warehouse", "transport_operations", r"鉄道|航空|空港|乗務員|運行管理|railway|airline|transport operations"),
    ("logistics_transport_warehouse", "logistics_warehouse", r"物流|倉庫|在庫管理|ロジスティクス|warehouse|logistics"),
    ("manufacturing_maintenance_skilled", "maintenance_mechanic", r"整備士|メカニック|設備保全|修理|mechanic|maintenance technician"),
    ("manufacturing_maintenance_skilled", "skilled_construction_worker", r"技能工|工事スタッフ|電気工|溶接|配管工|construction worker|welder"),
    ("manufacturing_maintenance_skilled", "manufacturing_operator", r"製造(?:スタッフ|オペレーター|技術職|管理職)?|生産管理|機械オペレーター|工場(?:スタッフ|内軽作業)|組立|加工|manufacturing operator|factory worker"),
    ("public_organizations", "government_public_service", r"国家公務員|地方公務員|市役所|区役所|官公庁|public servant|government officer"),
    ("public_organizations", "association_nonprofit_staff", r"団体職員|NPO職員|NGO職員|公益法人職員|association staff|nonprofit"),
    ("security_cleaning_agriculture", "security_safety", r"警備員|警察官|消防士|自衛官|security guard|police officer|firefighter"),
    ("security_cleaning_agriculture", "cleaning_facility_service", r"清掃|美化|ビルクリーニング|cleaner|janitor"),
    ("security_cleaning_agriculture", "agriculture_forestry_fisheries", r"農業|林業|漁業|水産|畜産|farmer|forestry|fisher"),
    ("sales_customer_success", "general_sales", r"(?:^|[【】／/_\s-])営業(?:$|[【】／/_\s-])|営業職|営業担当|営業スタッフ|ルート営業|官庁営業|OEM営業|セールス|\bsales\b"),
)
#: Specialty tags, and titles that say nothing of an occupation.
SPECIALTIES = (
    ("iOS", r"\biOS\b|\bSwift(?:UI)?\b"), ("Android", r"\bAndroid\b|\bKotlin\b"), ("Unity", r"\bUnity\b"), ("Unreal Engine", r"\bUnreal(?: Engine)?\b"), ("AI・機械学習", r"\bAI\b|機械学習|machine learning|\bLLM\b"),
    ("Web", r"\bWeb\b|フロントエンド|バックエンド|full.?stack"), ("中国語", "中国語|Mandarin|Chinese"), ("英語", "英語|English|TOEIC"),
)
GENERIC = r"総合職|オープンポジション|職種未定|ポジション相談|general position"


def specialties(title: Column, description: Column) -> Column:
    """The tags that a title and a whole description name."""
    return all_matches(F.concat_ws("\n", title, F.coalesce(description, F.lit(""))), SPECIALTIES)


def classify(title: Column, description: Column, tags: Column | None = None) -> Column:
    """struct(family, role, secondary: array of struct(family, role), tags, confidence).

    All rules that the title matches count; a description's first 600 characters only if the title is generic and
    matches none, and if their rules are of one family. The first rule is primary; at most two more families follow.
    """
    patterns = [p for _, _, p in RULES]
    tags = specialties(title, description) if tags is None else tags

    def by_title(found: Column) -> Column:
        text = F.when((F.size(found) == 0) & matches(title, GENERIC), F.substring(F.coalesce(description, F.lit("")), 1, 600))
        none = F.array().cast("array<int>")
        return once(once(text, lambda x: F.when(x.isNull(), none).otherwise(matched_numbers(x, patterns))), lambda other: chosen(found, other))

    def chosen(found: Column, other: Column) -> Column:
        family = lambda numbers: F.transform(numbers, lambda i: F.get(F.lit(_FAMILY_OF), i))
        use = (F.size(found) == 0) & (F.size(F.array_distinct(family(other))) == 1)
        numbers = F.when(F.size(found) > 0, found).when(use, other).otherwise(F.array(F.lit(len(RULES))))
        confidence = F.when(F.size(found) > 0, "high").when(use, "medium").otherwise("low")
        return once(F.transform(numbers, lambda i: F.struct(F.get(F.lit(_FAMILY_OF), i).alias("family"), F.get(F.lit(_ROLE_OF), i).alias("role"))), lambda rules: _selection(rules, tags, confidence))

    return once(matched_numbers(title, patterns), by_title)


_FAMILY_OF, _ROLE_OF = [f for f, _, _ in RULES] + ["other"], [r for _, r, _ in RULES] + ["other_unclassified"]


def _selection(rules: Column, tags: Column, confidence: Column) -> Column:
    primary = F.get(rules, 0)
    families = F.array_distinct(F.transform(rules, lambda x: x["family"]))
    others = F.slice(F.filter(families, lambda f: f != primary["family"]), 1, 2)
    secondary = F.transform(others, lambda f: F.get(F.filter(rules, lambda x: x["family"] == f), 0))
    return F.struct(primary["family"].alias("family"), primary["role"].alias("role"), secondary.alias("secondary"), tags.alias("tags"), confidence.alias("confidence"))


def all_families(occupation: Column) -> Column:
    return F.array_distinct(F.concat(F.array(occupation["family"]), F.transform(occupation["secondary"], lambda x: x["family"])))


def role_weight(occupation: Column, priorities: dict[str, float]) -> Column:
    """The largest weight of the occupation's families, roles and aliases; 0 without."""
    return once(occupation, lambda o: _weight(o, priorities))


def _weight(occupation: Column, priorities: dict[str, float]) -> Column:
    of = F.create_map(*[x for k, v in priorities.items() for x in (F.lit(k), F.lit(float(v)))]) if priorities else F.create_map().cast("map<string,double>")
    chosen = F.concat(F.array(F.struct(occupation["family"].alias("family"), occupation["role"].alias("role"))), occupation["secondary"])
    role, tags = occupation["role"], occupation["tags"]
    aliases = (
        ("product_web_ai_engineering", occupation["family"] == "it_web_software"), ("ios_engineering", (role == "mobile_app_engineer") & F.array_contains(tags, "iOS")), ("unity_game_engineering", (role == "game_engineer") & F.array_contains(tags, "Unity")),
        ("office_administration", occupation["family"] == "office_administration"), ("education_administration", role == "academic_affairs_school_operations"), ("human_resources_recruiting", role == "human_resources_recruiting"),
        ("bilingual_coordination", role.isin("trade_international_office", "interpreter_translator")),
    )
    names = F.concat(F.flatten(F.transform(chosen, lambda x: F.array(x["family"], x["role"]))), F.array_compact(F.array(*[F.when(ok, a) for a, ok in aliases])))
    return F.coalesce(F.array_max(F.array_compact(F.transform(names, lambda n: F.try_element_at(of, n)))), F.lit(0.0))
