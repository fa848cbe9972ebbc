"""Rule tables and vocabularies of the evidence pipeline. Everything here is data: operators take it as arguments."""

from __future__ import annotations

# The signal types with the profile fields each may touch, and their category.
SIGNAL_FIELDS = {
    "ownership_change": ["subsidiaries", "business_area", "risk_rating"],
    "new_subsidiary": ["subsidiaries", "known_jurisdictions", "risk_rating"],
    "new_jurisdiction": ["known_jurisdictions", "risk_rating"],
    "business_activity_change": ["business_area", "known_products", "risk_rating"],
    "digital_asset_activity": ["business_area", "known_products", "risk_rating"],
    "treasury_policy_change": ["business_area", "known_products", "risk_rating"],
    "regulatory_scrutiny": ["risk_rating", "business_area"],
    "jurisdiction_restriction": ["known_jurisdictions", "risk_rating"],
    "new_product": ["known_products", "business_area"],
    "public_listing": ["entity_type", "known_products"],
    "commercial_opportunity": ["known_products", "business_area"],
    "domain_registration": ["websites", "known_jurisdictions", "risk_rating"],
    "risk_rating_review": ["risk_rating", "known_products", "business_area"],
}
SCALAR_FIELDS = ("risk_rating", "entity_type", "domicile")
FACT_QUALITY = {"A": "0.85", "B": "0.72", "C": "0.55", "D": "0.35"}
ALERT_QUALITY = {"A": "0.95", "B": "0.80", "C": "0.55", "D": "0.30"}
OFFICIAL = ("company_newsroom", "official_blog", "product_page", "investor_relations", "regulator", "sec_filing", "domain_rdap")
# Company suffixes.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "s.a", "sa", "pte", "plc", "group")
#: Ranks of a comparison's materiality.
MATERIALITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY_POINTS = {"critical": 130, "high": 90, "medium": 45, "low": 15}
CATEGORY_POINTS = {"risk": 32, "ownership_control": 22, "mixed": 12, "opportunity": 5}
SOURCE_POINTS = {"A": 12, "B": 8, "C": 4, "D": 0}
FIELD_POINTS = {"risk_rating": 10, "known_jurisdictions": 10, "subsidiaries": 9, "business_area": 8, "websites": 6, "known_products": 4, "entity_type": 4}
SIGNAL_POINTS = {
    "regulatory_scrutiny": 26,
    "jurisdiction_restriction": 25,
    "risk_rating_review": 22,
    "ownership_change": 20,
    "new_subsidiary": 17,
    "new_jurisdiction": 16,
    "treasury_policy_change": 16,
    "digital_asset_activity": 15,
    "business_activity_change": 14,
    "domain_registration": 14,
    "new_product": 2,
    "public_listing": 2,
    "commercial_opportunity": 1,
}
CATEGORY = {
    "regulatory_scrutiny": "risk",
    "jurisdiction_restriction": "risk",
    "risk_rating_review": "risk",
    "ownership_change": "ownership_control",
    "new_subsidiary": "ownership_control",
    "commercial_opportunity": "opportunity",
    "new_product": "opportunity",
    "public_listing": "opportunity",
}

# Keywords that raise an alert's score, and its business impact, with their weights.
MATERIAL_KEYWORDS = {
    "sanction": 12,
    "ofac": 12,
    "north korea": 12,
    "dprk": 12,
    "russia": 9,
    "ransomware": 11,
    "darknet": 11,
    "aml": 9,
    "cftc": 9,
    "regulatory": 8,
    "blocked": 8,
    "jurisdiction": 6,
    "acquisition": 8,
    "subsidiary": 7,
    "bitcoin": 8,
    "treasury": 8,
    "country-code": 7,
    "domain": 6,
    "gambling": 8,
    "virtual currency exchange": 9,
    "ai chip": 9,
    "tpu": 9,
    "tensor processing unit": 9,
    "ai infrastructure": 8,
    "google cloud": 7,
    "anthropic": 7,
    "nvidia": 6,
}
BUSINESS_IMPACT_KEYWORDS = {
    "sanction": 36,
    "ofac": 34,
    "north korea": 34,
    "dprk": 34,
    "russia": 24,
    "ransomware": 32,
    "darknet": 32,
    "aml": 24,
    "regulatory scrutiny": 22,
    "blocked": 20,
    "gambling licence": 18,
    "country-code": 16,
    "domain": 10,
    "bitcoin": 14,
    "treasury reserve": 16,
}
# Points of a model's severity, of a validated fact and of one to review.
MODEL_SEVERITY_POINTS = {"critical": 55, "high": 32, "medium": 10, "low": 0}

#: Words of the test texts, which hold none of the above, for the registered queries.
KEYWORDS = {"pathetic": 12, "scum": 12, "idiot": 11, "trash": 9, "moron": 9, "licence": 6, "license": 6, "clown": 8, "jurisdiction": 6, "russia": 9}
IMPACT_KEYWORDS = {"scum": 36, "idiot": 34, "trash": 24, "worthless": 22, "license": 10}

#: Rows (fact_type, priority, any_of, none_of, object, value, jurisdiction, direct, ambiguous, derived). In a document the
#: first row by priority holds for its fact type. The words are those of the test texts.
FACT_RULES = [
    ("regulatory_scrutiny", 1, ["scum", "pathetic"], [], "Russia conduct notice", "notice", None, 1, 0, 0),
    ("regulatory_scrutiny", 2, ["idiot", "moron"], [], "Conduct complaint", "complaint", None, 0, 0, 0),
    ("risk_rating_review", 1, ["worthless"], ["idiot"], "Product complaint", "complaint", None, 0, 1, 0),
    ("jurisdiction_restriction", 1, ["disgusting"], [], "Blocked market", "blocked", "NATION_3; NATION_4", 1, 0, 0),
    ("ownership_change", 1, ["general public license"], [], "Copyleft Holding AG; FURNITURE", "acquired", None, 1, 0, 0),
    ("new_product", 1, ["mit license"], [], "Open release", "launch", None, 0, 0, 1),
    ("commercial_opportunity", 1, ["apache license"], [], "Partner release", "release", None, 0, 0, 1),
    ("new_jurisdiction", 1, ["clown", "trash"], [], "Market entry", "entry", "NATION_7; EUROPE", 0, 0, 0),
    ("business_activity_change", 1, [" | "], [], "MACHINERY; Table trade", "trade", None, 0, 0, 0),
    ("public_listing", 1, ["cc by-nc"], [], "Listed entity", "listing", None, 0, 0, 1),
]

# Other names of signal types and of profile fields in a model's answers, and the severities it may name.
SIGNAL_TYPE_ALIASES = {
    "adverse_media": "regulatory_scrutiny",
    "negative_news": "regulatory_scrutiny",
    "legal_risk": "regulatory_scrutiny",
    "regulatory_action": "regulatory_scrutiny",
    "sanctions_exposure": "jurisdiction_restriction",
    "sanctioned_country_exposure": "jurisdiction_restriction",
    "jurisdiction_expansion": "new_jurisdiction",
    "geographic_expansion": "new_jurisdiction",
    "country_expansion": "new_jurisdiction",
    "market_entry": "new_jurisdiction",
    "new_market": "new_jurisdiction",
    "business_model_change": "business_activity_change",
    "business_pivot": "business_activity_change",
    "product_launch": "new_product",
    "new_service": "new_product",
    "funding_round": "commercial_opportunity",
    "commercial_expansion": "commercial_opportunity",
    "domain_switch": "domain_registration",
    "website_change": "business_activity_change",
    "kyc_refresh": "risk_rating_review",
    "risk_reclassification": "risk_rating_review",
}
FIELD_ALIASES = {
    "jurisdiction": "known_jurisdictions",
    "jurisdictions": "known_jurisdictions",
    "countries": "known_jurisdictions",
    "country": "known_jurisdictions",
    "products": "known_products",
    "product": "known_products",
    "services": "known_products",
    "service": "known_products",
    "business_model": "business_area",
    "business_activity": "business_area",
    "activity": "business_area",
    "risk": "risk_rating",
    "risk_level": "risk_rating",
    "rating": "risk_rating",
    "legal_entities": "subsidiaries",
    "legal_entity": "subsidiaries",
    "entities": "subsidiaries",
    "domain": "websites",
    "website": "websites",
    "entity": "entity_type",
}
SEVERITIES = ("low", "medium", "high", "critical")

#: Words of a sentence that tells something, and of page furniture.
BODY_MARKERS = ("announced", "entered into", "has closed", "has blocked access", "investigates whether", "operating without", "disclosed", "ha publicado", "ha emitido", "today announced", "is currently available", "is a global", "is natively issued", "redeemable")
JUNK_MARKERS = ("skip to main content", "ir al contenido", "search / search", "securities registered pursuant", "pre-commencement communications", "check the appropriate box", " | the guardian", " | el pa", " | cadena ser", " | actualidad", " | economia")
