"""Fact rules as data: for each fact type a ladder of rows, of which the first that holds gives the fact."""

from __future__ import annotations

from typing import NamedTuple


class FactRule(NamedTuple):
    """A row holds if each of its clauses has a term that a document has.

    A term is looked for in the lower-cased text; 'title:x' in the lower-cased title; 'source:x' is a source type.
    With ``capture``, a pattern over the text in its own case, the row holds only where it matches, and its first group is the object.
    With ``among``, the object and the jurisdiction are those of these jurisdictions that the text names, and the second part of each
    pair in ``added`` whose first part is in the text; the row holds only if there is one. {name} and {object} are filled in.
    """

    fact_type: str
    when: tuple[tuple[str, ...], ...]
    object: str
    value: str
    jurisdiction: str | None = None
    fields: tuple[str, ...] = ()
    direct: bool = True
    ambiguous: bool = False
    derived: bool = False
    capture: str = ""
    among: tuple[str, ...] = ()
    added: tuple[tuple[str, str], ...] = ()


def with_terms(rules: list[FactRule], terms: dict[str, str]) -> list[FactRule]:
    """The same ladders over another vocabulary: each term is replaced by its entry, where it has one; the scope before a colon stays."""

    def change(term: str) -> str:
        scope, colon, word = term.rpartition(":") if term.startswith(("title:", "source:")) else ("", "", term)
        return scope + colon + terms.get(word, word)

    return [r._replace(when=tuple(tuple(map(change, c)) for c in r.when), added=tuple((change(t), v) for t, v in r.added), capture=terms.get(r.capture, r.capture)) for r in rules]


# Jurisdictions and the patterns that name them, in the order of the results.
JURISDICTIONS = {
    "United States": (r"\bUnited States\b", r"\bU\.S\.\b", r"\bUS\b"),
    "United Kingdom": (r"\bUnited Kingdom\b", r"\bUK\b"),
    "European Union": (r"\bEuropean Union\b", r"\bEU\b"),
    "Luxembourg": (r"\bLuxembourg\b",),
    "British Virgin Islands": (r"\bBritish Virgin Islands\b", r"\bBVI\b"),
    "Singapore": (r"\bSingapore\b",),
    "Bermuda": (r"\bBermuda\b",),
    "Jersey": (r"\bJersey\b",),
    "Australia": (r"\bAustralia\b", r"\b\.au\b", r"\bauDA\b"),
    "Spain": (r"\bSpain\b", r"\bEspa(?:n|ñ)a\b"),
    "Russia": (r"\bRussia\b", r"\bRussian Federation\b", r"\bMoscow\b", r"\bSt\. Petersburg\b"),
    "North Korea": (r"\bNorth Korea\b", r"\bDPRK\b", r"\bDemocratic People's Republic of Korea\b"),
}

_BUYS = ("acquisition", "acquire", "entered into an agreement to acquire")
_GAMBLING = ("event-based binary options", "prediction market", "apuestas", "gambling licence", "licencia de juego")
_STOCKS = ("xstocks", "tokenized u.s. stocks", "tokenized equities")
_OWNER = ("registrant name coinbase", "eligibility name coinbase", "trademark owner")
_SEARCH = ("google", "alphabet")
_CHIPS = ("tpu", "tensor processing unit", "ai chip")
_CLOUD = (*_CHIPS, "ai infrastructure", "google cloud")
_RDAP, _AU, _TOBACCO = ("source:domain_rdap",), ("coinbase.au",), ("british american tobacco",)
_KOREA = ("north korea", "dprk")
_BOUGHT = ("purchased 4,710 bitcoin", "title:purchase of bitcoin")
_OFFER = {"fields": ("known_products", "business_area"), "derived": True}

# The ladders' terms, objects, statements, jurisdictions and fields, in order.
FACT_LADDERS = [
    FactRule("ownership_change", (_BUYS, ("bitstamp",)), "Bitstamp Ltd.", "Robinhood closed its acquisition of Bitstamp Ltd., a global cryptocurrency exchange."),
    FactRule("ownership_change", (_BUYS, ("ninjatrader",)), "NinjaTrader", "Kraken entered into an agreement to acquire NinjaTrader for $1.5 billion."),
    FactRule("ownership_change", (_BUYS,), "{object}", "{name} announced an acquisition involving {object}.", ambiguous=True, capture=r"acquire\s+([A-Z][A-Za-z0-9&.,'\-\s]{2,80})"),
    FactRule("new_subsidiary", (("bitstamp legal entities", "bitstamp europe"),), "Bitstamp Europe S.A.; Bitstamp UK Ltd.; Bitstamp Ltd.; Bitstamp Global Ltd.; Bitstamp Asia Pte Ltd", "Bitstamp disclosures list regulated legal entities serving clients by residency.", "Luxembourg; United Kingdom; British Virgin Islands; Singapore"),
    FactRule("new_jurisdiction", (("bitstamp",),), "{object}", "Bitstamp legal entity disclosures add licensed crypto-asset service jurisdictions.", among=("Luxembourg", "United Kingdom", "British Virgin Islands", "Singapore")),
    FactRule("new_jurisdiction", (("xstocks", "bermuda", "jersey"),), "{object}", "xStocks evidence references Jersey issuance, Bermuda digital-asset licensing, or non-U.S. eligibility.", among=("Jersey", "Bermuda"), added=(("non-u.s", "non-U.S. clients"),)),
    FactRule("new_jurisdiction", (("garantex",), ("russia",)), "Russia", "Treasury evidence says the majority of Garantex operations are carried out in Moscow and St. Petersburg, Russia.", "Russia"),
    FactRule("new_jurisdiction", (_TOBACCO, _KOREA), "North Korea", "OFAC evidence describes North Korea joint-venture profits and exports to the North Korean Embassy in Singapore.", "North Korea"),
    FactRule("new_jurisdiction", (_RDAP, _AU, _OWNER), "Australia", "RDAP evidence ties the coinbase.au country-code domain to Coinbase identity data.", "Australia", ("known_jurisdictions", "risk_rating")),
    FactRule("business_activity_change", (_GAMBLING,), "event-based binary options and gambling-market exposure", "Polymarket evidence describes event-based binary options, prediction markets, or gambling-license exposure."),
    FactRule("business_activity_change", (("global cryptocurrency exchange",),), "global cryptocurrency exchange", "The Bitstamp acquisition adds a global cryptocurrency exchange to Robinhood's business profile."),
    FactRule("business_activity_change", (("futures trading platform",),), "U.S. futures and multi-asset professional trading", "The NinjaTrader acquisition expands Kraken toward U.S. futures and multi-asset professional trading."),
    FactRule("business_activity_change", (("garantex",), ("virtual currency exchange",)), "Russia-linked virtual currency exchange with AML/CFT deficiencies", "Treasury evidence describes Garantex as a Russia-linked virtual currency exchange with AML/CFT deficiencies and illicit transaction exposure.", "Russia"),
    FactRule("business_activity_change", (_TOBACCO, ("north korea",)), "North Korea tobacco joint-venture and export exposure", "OFAC evidence describes BAT-related North Korea joint-venture profits and tobacco exports involving U.S. financial institutions.", "North Korea"),
    FactRule("business_activity_change", (_RDAP, _AU, ("trademark owner",)), "Australia country-code domain monitoring signal", "RDAP evidence links coinbase.au to Coinbase identity data, creating a market-entry or defensive-domain review item.", "Australia", ("business_area", "known_products", "risk_rating")),
    FactRule("business_activity_change", (_SEARCH, _CLOUD), "AI infrastructure and custom silicon expansion", "Fresh evidence describes Google's expansion of AI infrastructure, TPUs, or AI chip commercialization.", None, ("business_area", "known_products", "risk_rating")),
    FactRule("digital_asset_activity", (_BOUGHT,), "4,710 Bitcoin purchase", "GameStop announced that it purchased 4,710 Bitcoin."),
    FactRule("digital_asset_activity", (("treasury reserve asset",),), "Bitcoin treasury reserve asset", "GameStop approved Bitcoin as a treasury reserve asset."),
    FactRule("digital_asset_activity", (("pledged portion of its digital assets as collateral",),), "digital assets pledged as collateral", "GameStop pledged part of its digital assets as collateral in a covered-call strategy."),
    FactRule("digital_asset_activity", (("bitcoin and other crypto",), ("regulatory uncertainty",)), "Bitcoin and other crypto-currencies", "GameStop disclosed regulatory and legal uncertainty around Bitcoin and other crypto-currencies."),
    FactRule("digital_asset_activity", (_STOCKS,), "tokenized U.S. stocks and ETFs", "Kraken evidence describes tokenized U.S. stocks and ETFs through xStocks."),
    FactRule("digital_asset_activity", (("circle payments network", "stablecoins like usdc and eurc"),), "USDC/EURC stablecoin payments", "Circle Payments Network enables payments with 24/7 settlement via stablecoins like USDC and EURC."),
    FactRule("digital_asset_activity", (("usdc",), ("global payments",)), "USDC global payments", "USDC enables near-instant, low-cost global payments and 24/7 liquidity."),
    FactRule("digital_asset_activity", (("circle mint",),), "USDC/EURC access and redemption", "Circle Mint gives distributors access to and redemption of USDC and EURC."),
    FactRule("digital_asset_activity", (("crypto-assets services",),), "crypto-asset services", "Bitstamp legal entities provide crypto-asset services based on client residency."),
    FactRule("digital_asset_activity", (("garantex",), ("virtual currency exchange", "virtual currencies")), "sanctioned Russia-linked virtual currency exchange", "Treasury evidence links Garantex virtual currency exchange activity to illicit actors, darknet markets, ransomware, and Russian financial-services sanctions exposure.", "Russia"),
    FactRule("treasury_policy_change", (("treasury reserve asset",),), "Bitcoin treasury reserve asset", "GameStop's board approved Bitcoin as a treasury reserve asset."),
    FactRule("treasury_policy_change", (_BOUGHT,), "4,710 Bitcoin purchase", "GameStop purchased 4,710 Bitcoin after its baseline review."),
    FactRule("treasury_policy_change", (("covered-call strategy",),), "digital assets collateral and covered-call strategy", "GameStop used digital assets as collateral in connection with a covered-call strategy."),
    FactRule("regulatory_scrutiny", (("garantex",), ("ofac", "sanctioned")), "OFAC sanctions on Garantex", "Treasury sanctioned Garantex and described illicit transaction exposure, AML/CFT deficiencies, and Russia financial-services sanctions risk.", "Russia"),
    FactRule("regulatory_scrutiny", (_TOBACCO, ("ofac", "settlement"), ("north korea",)), "$508 million OFAC settlement for North Korea sanctions violations", "OFAC announced a $508 million settlement with British American Tobacco for apparent violations of U.S. sanctions on North Korea and WMD proliferators.", "North Korea"),
    FactRule("regulatory_scrutiny", (("cftc",), ("penalty", "order")), "CFTC Polymarket order and $1.4 million penalty", "The CFTC ordered Polymarket's operator to pay a $1.4 million penalty for off-exchange event-based binary options and registration failures.", "United States"),
    FactRule("regulatory_scrutiny", (("blocked access", "bloqueo", "expediente sancionador", "gambling licence", "licencia de juego", "sin licencia"),), "Spanish gambling-license investigation", "Spanish authorities opened or reported a gambling-license investigation involving Polymarket.", "Spain"),
    FactRule("jurisdiction_restriction", (("garantex",), ("russia", "russian federation"), ("sanction", "e.o. 14024")), "Russia sanctions and virtual-currency evasion exposure", "Treasury designated Garantex for operating in the Russian Federation financial-services sector and highlighted virtual-currency sanctions-evasion risk.", "Russia"),
    FactRule("jurisdiction_restriction", (_TOBACCO, _KOREA), "North Korea sanctions exposure", "OFAC evidence describes North Korea-related business and payments touching the U.S. financial system.", "North Korea"),
    FactRule("jurisdiction_restriction", (("blocked access", "bloqueo", "sin licencia", "without a gambling licence"),), "Spain market-access block", "Spain blocked access or reported enforcement related to operating without a gambling license.", "Spain"),
    FactRule("new_product", (("circle payments network", "title:circle payments network"),), "Circle Payments Network", "Circle Payments Network enables 24/7 real-time settlement with stablecoins."),
    FactRule("new_product", (("circle mint", "title:circle mint"),), "Circle Mint", "Circle Mint gives distributors access to and redemption of USDC and EURC."),
    FactRule("new_product", (("title:usdc", "usdc"), ("title:usdc", "global payments")), "USDC global payments", "USDC enables 24/7 liquidity and near-instant global payments."),
    FactRule("new_product", (_STOCKS,), "xStocks tokenized equities", "Kraken evidence describes tokenized U.S. stocks and ETFs through xStocks."),
    FactRule("new_product", (_SEARCH, _CHIPS), "Google Cloud TPUs and AI chips", "Fresh evidence describes Google expanding Tensor Processing Units or AI chip offerings for AI infrastructure customers."),
    FactRule("public_listing", (("investor relations",), ("circle internet group",)), "Circle Investor Relations profile", "Circle maintains investor-relations materials describing its public-company profile and stablecoin network.", direct=False, derived=True),
    FactRule("commercial_opportunity", (("purchased 4,710 bitcoin", "treasury reserve asset"),), "Bitcoin custody and treasury services opportunity", "GameStop's Bitcoin treasury activity creates a custody, trading, lending, or treasury-services conversation.", **_OFFER),
    FactRule("commercial_opportunity", (("circle payments network",),), "Circle Payments Network payments opportunity", "Circle Payments Network creates an institutional payments, FX, and stablecoin settlement opportunity.", **_OFFER),
    FactRule("commercial_opportunity", (("circle mint",),), "Circle Mint distribution opportunity", "Circle Mint creates an RM opportunity around USDC/EURC access, redemption, and distribution.", **_OFFER),
    FactRule("commercial_opportunity", (("usdc",), ("global payments",)), "USDC liquidity and payments opportunity", "USDC payment and liquidity evidence creates an RM opportunity for stablecoin settlement and treasury services.", **_OFFER),
    FactRule("commercial_opportunity", (_SEARCH, _CLOUD), "AI infrastructure and cloud banking opportunity", "Google's AI infrastructure expansion creates an RM conversation around corporate treasury, liquidity, FX, financing, and operating-account needs.", **_OFFER),
    FactRule("domain_registration", (_RDAP, _AU, _OWNER), "https://coinbase.au", "RDAP ties coinbase.au to Coinbase, Inc. through registrant and COINBASE trademark-owner eligibility data.", "Australia", ("websites", "known_jurisdictions", "risk_rating")),
    FactRule("risk_rating_review", (_RDAP, _AU, ("trademark owner",)), "country-code domain expansion review", "The coinbase.au RDAP record should be reviewed to confirm whether the domain is defensive, pre-launch, or active local market evidence.", "Australia", ("risk_rating", "known_jurisdictions", "business_area")),
    FactRule("risk_rating_review", (("garantex",), ("illicit actors", "darknet markets", "ransomware", "aml/cft deficiencies")), "Garantex illicit finance and AML/CFT risk", "Treasury evidence associates Garantex with illicit actors, darknet markets, ransomware proceeds, and AML/CFT deficiencies.", "Russia"),
    FactRule("risk_rating_review", (_TOBACCO, (*_KOREA, "wmd", "designated north korean banks")), "North Korea sanctions and WMD-proliferator risk", "OFAC evidence describes apparent North Korea and WMD sanctions violations involving BAT, intermediaries, and U.S. financial institutions.", "North Korea"),
    FactRule("risk_rating_review", (("regulatory uncertainty", "increased regulatory scrutiny"),), "digital-asset regulatory uncertainty", "GameStop disclosed regulatory uncertainty and potential increased scrutiny around Bitcoin and crypto-currencies."),
    FactRule("risk_rating_review", (("covered-call strategy",), ("digital assets",)), "digital assets collateral strategy", "GameStop's use of digital assets as collateral calls for risk-rating review.", derived=True),
]

#: The same ladders over pieces of words of the test texts, which hold none of the terms above; for the registered queries.
TEST_TERMS = {
    "acquisition": "license", "acquire": "version", "entered into an agreement to acquire": "general public license", "bitstamp": "erach", "ninjatrader": "trash",
    "bitstamp legal entities": "erach idiot", "bitstamp europe": "cherver", "xstocks": "thering", "bermuda": "thsted", "jersey": "onthed", "non-u.s": "theres",
    "garantex": "thesat", "russia": "thanon", "british american tobacco": "ersch", "north korea": "erkeit", "dprk": "chheit", "domain_rdap": "sec_filing",
    "coinbase.au": "queque", "registrant name coinbase": "quean", "eligibility name coinbase": "queou", "trademark owner": "ciónll",
    "event-based binary options": "scum", "prediction market": "pathetic", "apuestas": "moron", "gambling licence": "worthless", "licencia de juego": "ciónciónc",
    "global cryptocurrency exchange": "disgusting", "futures trading platform": "clown", "virtual currency exchange": "thenly", "virtual currencies": "thndin",
    "google": "erheit", "alphabet": "einer", "tpu": "schung", "tensor processing unit": "beung", "ai chip": "telich", "ai infrastructure": "ungver", "google cloud": "ölich",
    "purchased 4,710 bitcoin": "eaesth", "purchase of bitcoin": "the", "treasury reserve asset": "mit license", "pledged portion of its digital assets as collateral": "edanon",
    "bitcoin and other crypto": "thinon", "regulatory uncertainty": "therha", "tokenized u.s. stocks": "thanst", "tokenized equities": "erhation", "circle payments network": "trash",
    "stablecoins like usdc and eurc": "inhash", "usdc": "ouier", "global payments": "aique", "circle mint": "mentré", "crypto-assets services": "treai", "covered-call strategy": "eringing",
    "ofac": "thanha", "sanctioned": "thontion", "settlement": "besch", "cftc": "aiier", "penalty": "onier", "order": "leelle", "blocked access": "idiot", "bloqueo": "ciónnue",
    "expediente sancionador": "ómente", "sin licencia": "ñmente", "russian federation": "thonan", "sanction": "thorwh", "e.o. 14024": "thaning", "without a gambling licence": "apache license",
    "investor relations": "license", "circle internet group": "version", "illicit actors": "theati", "darknet markets": "onthti", "ransomware": "edon", "aml/cft deficiencies": "thsesat",
    "wmd": "verheit", "designated north korean banks": "ungsch", "increased regulatory scrutiny": "thheou", "digital assets": "erenan",
    r"acquire\s+([A-Z][A-Za-z0-9&.,'\-\s]{2,80})": r"[Ll]icensed? under the\s+([A-Z][A-Za-z0-9&.,'\-\s]{2,80})",
}
TEST_JURISDICTIONS = {"United Kingdom": (r"\bthe\b",), "Luxembourg": (r"lich\b", r"\bdie\b"), "British Virgin Islands": (r"\bles?\b",), "Singapore": (r"\bqueaux\b",), "Bermuda": (r"thsted",), "Jersey": (r"onthed", r"\bthan\b")}
