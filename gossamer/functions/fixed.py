"""Fixed values that results depend on."""

# Top-level names that count as a signal of their own.
SUSPICIOUS_SUFFIXES = ["xyz", "cc", "tk", "ml", "ga", "cf", "gq", "top", "pw", "work", "click", "link", "online"]
NEW_DOMAIN_DAYS, MANY_HYPHENS = 90, 2

# Public suffixes of more than one label; any other host's suffix is its last label.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr", "co.kr"]

# Brands looked for in titles, in this order.
BRANDS = [
    "paypal", "amazon", "microsoft", "apple", "netflix", "bank", "chase", "wellsfargo", "americanexpress", "visa",
    "mastercard", "facebook", "instagram", "google", "outlook", "office365", "docusign", "dhl", "fedex", "ups",
]

# Icon relations by preference, and the least bytes of an icon.
ICON_RELATIONS = ["icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon"]
ICON_BYTES = 16
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options"]
SUBDOMAIN_WORDS = ["admin", "panel", "login", "secure", "verify", "account", "update", "confirm", "api", "cpanel", "webmail", "mail", "staging", "test", "dev", "portal", "auth", "sso"]

# Autonomous systems by tier, with the tier's risk and each system's label.
ASN_TIERS = {
    ("bulletproof", 3): {
        213702: "Qwins Ltd", 198953: "Proton66 OOO", 401116: "NYBULA", 401120: "CHEAPY-HOST", 200593: "PROSPERO OOO", 214943: "Railnet LLC", 61432: "VAIZ-AS (Ukraine)",
        210950: "E-RISHENNYA-ASN (Ukraine)", 211736: "FDN3 (Ukraine)", 210848: "TK-NET (Seychelles)", 212283: "ROZA-AS (Bulgaria)", 204428: "SS-Net (Bulgaria)",
        44559: "MIRhosting (Stark Industries)", 216246: "Aeza Group Ltd", 57523: "Chang Way Technologies Co. Limited", 207566: "Chang Way Technologies Co. Limited",
        44477: "Stark Industries Solutions Ltd (PQ Hosting) — EU-sanctioned May 2025", 209847: "WorkTitans B.V. — Stark Industries rebrand post-sanctions",
        211252: "Delis LLC (CrazyRDP)", 401115: "EKABI (CrazyRDP downstream)",
    },
    ("threat_actor_linked", 2): {
        62212: "SmartApe OU — linked to FIN7", 42474: "SmartApe OU (Estonia)", 56694: "LLC Smart Ape (Russia)", 209588: "Flyservers S.A. — linked to ShadowSyndicate",
        209132: "Alviva Holding Limited — ransomware infrastructure", 51381: "1337TEAM LIMITED (ELITETEAM, Seychelles)", 60424: "1337TEAM LIMITED (ELITETEAM)",
        56873: "1337TEAM LIMITED (ELITETEAM)", 39770: "1337TEAM LIMITED (ELITETEAM)", 200373: "Drei-K-Tech-GmbH — DDoS proxy source",
    },
    ("anonymization", 1): {
        212238: "Datacamp Limited", 60068: "Datacamp Limited", 211612: "Datacamp Limited", 206092: "Datacamp Limited", 9009: "M247 Europe SRL", 16247: "M247 Ltd", 42973: "M247 Ltd",
        33837: "Fredrik Holmqvist (Tor exit node)", 201814: "MEVSPACE sp. z o.o. (CroxyProxy)", 202425: "IP Volume inc (Speedify VPN)", 17561: "Plainproxies (3xK Tech)",
        132817: "Webshare Proxy", 64267: "Rayobyte Proxy", 131642: "Rapidseedbox Proxy",
    },
}

# Pairs of types that may be linked: relation, and its words.
LINK_TYPES = [
    ("domain", "ip", "resolves-to", "{a} probably also points to server {b}"),
    ("domain", "registrar", "registered-by", "{a} was probably also registered through {b}"),
    ("domain", "cert_peer", "shares-cert", "{a} probably shares a TLS certificate with {b}"),
    ("domain", "favicon", "uses-favicon", "{a} probably uses the same page icon as {b}"),
    ("domain", "subdomain", "has-subdomain", "{b} is probably a subdomain of {a}"),
    ("domain", "jarm", "server-fingerprint", "{a} probably runs the same server software ({b})"),
    ("ip", "asn", "hosted-in", "server {a} is probably hosted by {b}"),
    ("ip", "geo", "located-in", "server {a} is probably located in {b}"),
    ("ip", "co_host", "also-hosts", "server {a} probably also hosts {b}"),
]

# Pairs of types that have a place of their own in a signature; all others share the last.
BUCKETS = [
    ("domain", "ip"), ("domain", "cert_peer"), ("domain", "favicon"), ("domain", "registrar"), ("domain", "asn"), ("domain", "jarm"),
    ("domain", "subdomain"), ("domain", "co_host"), ("ip", "asn"), ("ip", "geo"), ("ip", "co_host"), ("other", "other"),
]

# Types of the embedding's first layer; others count as the last.
EMBEDDED_TYPES = ["domain", "ip", "registrar", "cert_peer", "asn", "geo", "co_host", "unknown"]

# Category and label of each type, for reports.
TYPE_WORDS = [
    ("domain", "ownership", "Website address"), ("registrar", "ownership", "Who registered it"), ("subdomain", "ownership", "Related sub-page"),
    ("ip", "network", "Server address"), ("asn", "network", "Hosting company"), ("geo", "network", "Server location"), ("co_host", "network", "Other site, same server"),
    ("cert_peer", "fingerprint", "Shares security certificate"), ("favicon", "fingerprint", "Shares page icon"), ("jarm", "fingerprint", "Shares server fingerprint"),
]

#: Node budget: types that may be trimmed, in this order, with the number that stays.
NODE_BUDGET, TRIM = 50, [("co_host", 3), ("cert_peer", 5), ("subdomain", 8)]
CO_HOSTS = 15
TIMES = [0.5, 1.0, 2.0, 5.0, 10.0]

#: Campaigns: nodes at which expansion stops, levels, leaves a level.
CAMPAIGN_NODES, CAMPAIGN_DEPTH, CAMPAIGN_LEAVES = 80, 2, 5
HOPS, SHARED_LINES, ERROR_CHARS = 8, 2000, 200
#: Graphs of a comparison of all pairs.
COMPARED = 20
NULL_JARM = "0" * 62

# Height of a category's layer, and of each type in it.
LAYERS = {"ownership": 0.0, "network": 3.5, "fingerprint": 7.0}
LAYER_OFFSETS = {"domain": -0.3, "registrar": 0.3, "subdomain": 0.0, "ip": -0.4, "asn": 0.0, "geo": 0.4, "co_host": 0.8, "cert_peer": -0.3, "favicon": 0.0, "jarm": 0.3}

# Relations in plain words.
RELATION_WORDS = {
    "resolves-to": "points to", "registered-by": "registered by", "shares-cert": "shares certificate", "hosted-in": "hosted on", "located-in": "located in",
    "also-hosts": "shares server with", "uses-favicon": "shares page icon", "has-subdomain": "sub-page of", "server-fingerprint": "shares server fingerprint",
}
