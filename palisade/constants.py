"""Fixed values.

Word lists, lookup tables, thresholds and formats that decide results.  They are data, not logic: every
function takes them as defaults and accepts replacements.
"""

from __future__ import annotations

# --- vocabulary ---------------------------------------------------------------------------------------
SCOPE_TYPES = ("domain", "wildcard", "cidr", "ipv4", "ipv6", "asn", "url")
ASSET_TYPES = ("domain", "subdomain", "ipv4", "ipv6", "cidr", "url", "certificate", "asn", "technology", "cve")
TERMINAL_JOB_STATUSES = ("SUCCESS", "FAILED", "CANCELLED", "BLOCKED", "OUT_OF_SCOPE")

# --- addresses: ranges that must never be contacted unless they are themselves in scope ----------------
SENSITIVE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
    "240.0.0.0/4",
)
NOT_SENSITIVE_V4 = ("192.0.0.9/32", "192.0.0.10/32")
SENSITIVE_V6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16",
    "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6",
    "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
NOT_SENSITIVE_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)

# --- names --------------------------------------------------------------------------------------------
# A short default; pass the full public-suffix list as a parameter ("*.x" and "!x" entries are understood).
PUBLIC_SUFFIXES = (
    "app", "at", "au", "be", "biz", "br", "ca", "ch", "click", "cn", "co", "co.in", "co.jp", "co.kr", "co.nz",
    "co.uk", "co.za", "com", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "cz", "de", "dev", "dk", "edu", "es",
    "eu", "fi", "fr", "gov", "gov.uk", "gr", "hu", "ie", "in", "info", "int", "io", "it", "jp", "kr", "link", "me",
    "mil", "ml", "mx", "name", "net", "net.au", "nl", "no", "nz", "online", "org", "org.au", "org.uk", "pl", "pt",
    "ro", "ru", "se", "site", "tk", "top", "tr", "tv", "uk", "us", "work", "xyz", "za", "zip", "*.ck", "!www.ck",
)
# labels below a country code that stand for a kind of registrant
REGISTRANT_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "id", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SUSPICIOUS_TLDS = ("cf", "click", "ga", "gq", "link", "ml", "mov", "tk", "top", "work", "xyz", "zip")
DEFAULT_PORTS = {"http": 80, "https": 443}

# --- technologies -------------------------------------------------------------------------------------
# lower-case alias -> canonical name; names absent here become a slug of themselves
TECHNOLOGY_ALIASES = {
    "akamai": "akamai", "amazon cloudfront": "cloudfront", "angular": "angular", "angularjs": "angularjs",
    "apache": "apache-httpd", "apache http server": "apache-httpd", "apache httpd": "apache-httpd",
    "apache tomcat": "tomcat", "bootstrap": "bootstrap", "caddy": "caddy", "cloudflare": "cloudflare",
    "cloudfront": "cloudfront", "debian": "debian", "drupal": "drupal", "elasticsearch": "elasticsearch",
    "envoy": "envoy", "express": "express", "fastly": "fastly", "gitlab": "gitlab", "grafana": "grafana",
    "hsts": "hsts", "httpd": "apache-httpd", "iis": "iis", "jenkins": "jenkins", "jetty": "jetty",
    "joomla": "joomla", "jquery": "jquery", "kibana": "kibana", "lighttpd": "lighttpd", "microsoft iis": "iis",
    "microsoft-iis": "iis", "nginx": "nginx", "nginx web server": "nginx", "node.js": "nodejs",
    "nodejs": "nodejs", "openresty": "openresty", "php": "php", "react": "react", "tomcat": "tomcat",
    "ubuntu": "ubuntu", "varnish": "varnish", "vue": "vue", "vue.js": "vue", "wordpress": "wordpress",
}
# canonical name -> (vendor, product) of its CPE
VENDOR_PRODUCT = {
    "apache-httpd": ("apache", "http_server"), "drupal": ("drupal", "drupal"),
    "elasticsearch": ("elastic", "elasticsearch"), "gitlab": ("gitlab", "gitlab"),
    "grafana": ("grafana", "grafana"), "iis": ("microsoft", "internet_information_services"),
    "jenkins": ("jenkins", "jenkins"), "jetty": ("eclipse", "jetty"), "joomla": ("joomla", "joomla\\!"),
    "jquery": ("jquery", "jquery"), "kibana": ("elastic", "kibana"), "lighttpd": ("lighttpd", "lighttpd"),
    "nginx": ("f5", "nginx"), "nodejs": ("nodejs", "node.js"), "openresty": ("openresty", "openresty"),
    "php": ("php", "php"), "tomcat": ("apache", "tomcat"), "varnish": ("varnish-software", "varnish_cache"),
    "wordpress": ("wordpress", "wordpress"),
}
# fingerprint source -> (technology confidence, version confidence)
TECHNOLOGY_CONFIDENCE = {
    "bbot": (0.6, 0.5),
    "bbot-cpe": (0.6, 0.5),
    "httpx-server-header": (0.9, 0.8),
    "httpx-wappalyzer": (0.8, 0.7),
}
CURATED_CPE_CONFIDENCE = 0.8
SOURCE_CPE_CONFIDENCE = 0.5

# --- fixed patterns: versions, server headers, CPE parts --------------------------------------------------
VERSION_PATTERN = r"(?i)^v?([0-9]+(?:\.[0-9]+){0,3}[a-z0-9.+-]*)$"
SERVER_PATTERN = r"^([A-Za-z][A-Za-z0-9 ._-]*?)(?:/([0-9][A-Za-z0-9.+-]*))?(?:\s.*)?$"
TOKEN_PATTERN = r"^[a-z0-9._\-\\!]{1,128}$"
CPE_VERSION_PATTERN = r"^[0-9][0-9a-z._\-]{0,63}$"

# --- discovery source -> confidence (anything else: 0.5) -----------------------------------------------
SOURCE_CONFIDENCE = {
    "bbot": 0.7, "bounty-targets-data": 0.9, "certstream": 0.7, "cpe-correlation": 0.5, "dns": 0.95, "httpx": 0.95,
    "katana": 0.9, "manual": 1.0, "mapcidr": 1.0, "nuclei": 0.9, "scope_import": 1.0, "tlsx": 0.9, "uncover": 0.5,
}
DEFAULT_CONFIDENCE = 0.5

# --- scope: how specific a matching include rule is ----------------------------------------------------
SPECIFICITY = {"url": 6, "domain": 5, "ipv4": 5, "ipv6": 5, "asn": 5, "cidr": 4, "wildcard": 3}
EXPLICIT_BONUS = 10

# --- events: stream -> indices it may write -------------------------------------------------------------
STREAM_INDICES = {
    "assets": ("bb-assets", "bb-domains", "bb-ips", "bb-uncover", "bb-uncover-raw", "bb-urls"),
    "bbot": ("bb-bbot", "bb-bbot-raw"), "certstream": ("bb-certstream",), "changes": ("bb-changes",),
    "cve": ("bb-cve", "bb-kev"), "dns": ("bb-dns",), "httpx": ("bb-http", "bb-httpx-raw"),
    "katana": ("bb-katana", "bb-katana-raw", "bb-urls"), "nuclei": ("bb-nuclei", "bb-nuclei-raw"),
    "ops": ("bb-audit", "bb-errors", "bb-jobs", "bb-notifications", "bb-scans"), "tlsx": ("bb-tls", "bb-tlsx-raw"),
}
SCHEMA_VERSION = "1"
# index -> days kept
RETENTION_DAYS = {
    "bb-httpx-raw": 30, "bb-tlsx-raw": 30, "bb-katana-raw": 30, "bb-nuclei-raw": 30, "bb-bbot-raw": 30,
    "bb-uncover-raw": 30, "bb-certstream": 60, "bb-http": 90, "bb-tls": 90, "bb-dns": 90, "bb-urls": 90,
    "bb-katana": 90, "bb-bbot": 90, "bb-uncover": 90, "bb-jobs": 90, "bb-scans": 90, "bb-errors": 90,
    "bb-notifications": 90, "bb-assets": 730, "bb-domains": 730, "bb-ips": 730, "bb-changes": 730, "bb-audit": 730,
    "bb-nuclei": 730, "bb-cve": 730, "bb-kev": 730,
}

# --- notifications ---------------------------------------------------------------------------------------
SEVERITIES = ("info", "low", "medium", "high", "critical")
# event type -> (notification type, severity)
NOTIFIABLE = {
    "CERTIFICATE_EXPIRED": ("TLS_EXPIRING", "high"),
    "CERT_EXPIRING": ("TLS_EXPIRING", "medium"),
    "DLQ_EVENT": ("DLQ_EVENT", "medium"),
    "KEV_ADDED": ("NEW_KEV", "critical"),
    "NEW_CRITICAL_FINDING": ("NEW_CRITICAL_FINDING", "critical"),
    "NEW_CVE": ("NEW_CVE", "medium"),
    "NEW_DOMAIN": ("NEW_ASSET", "info"),
    "NEW_IP": ("NEW_IP", "info"),
    "NEW_SUBDOMAIN": ("NEW_SUBDOMAIN", "info"),
    "NEW_URL": ("NEW_ASSET", "info"),
    "SCAN_FAILURE": ("SCAN_FAILURE", "low"),
    "TECHNOLOGY_ADDED": ("TECHNOLOGY_CHANGED", "low"),
    "TECHNOLOGY_REMOVED": ("TECHNOLOGY_CHANGED", "low"),
    "TLS_CHANGED": ("TLS_CHANGED", "low"),
}
NOTIFICATION_TITLES = {
    "DLQ_EVENT": "Job dead-lettered",
    "NEW_ASSET": "New asset",
    "NEW_CRITICAL_FINDING": "New critical finding",
    "NEW_CVE": "New CVE",
    "NEW_IP": "New IP",
    "NEW_KEV": "Known exploited vulnerability (KEV)",
    "NEW_SUBDOMAIN": "New subdomain",
    "SCAN_FAILURE": "Scan failure",
    "TECHNOLOGY_CHANGED": "Technology changed",
    "TLS_CHANGED": "TLS changed",
    "TLS_EXPIRING": "TLS expiring",
}
DELIVERY_BACKOFF_SECONDS = (30, 120, 480)
DEFER_SECONDS = 60

# --- jobs ------------------------------------------------------------------------------------------------
# scanner -> (queue, accepted target kinds)
SCANNERS = {
    "bbot": ("bbot", ("domain",)), "dns": ("dns", ("domain",)),
    "httpx": ("httpx", ("domain", "ipv4", "ipv6", "url")), "katana": ("katana", ("domain", "url")),
    "mapcidr": ("mapcidr", ("cidr",)), "nuclei": ("nuclei", ("domain", "ipv4", "ipv6", "url")),
    "tlsx": ("tlsx", ("domain", "ipv4", "ipv6")), "uncover": ("discovery", ("domain",)),
}
HIGH_PRIORITY = 7
QUEUE_CAP = 25
MAX_CIDR_SIZE = 256
MAX_RETRIES = 3
RETRY_BASE_SECONDS = 30
HEARTBEAT_SECONDS = 15
MAX_SCAN_SECONDS = 900
STALE_QUEUED_SECONDS = 1800
FEASIBLE_DEADLINE_SHARE = 0.8

# --- observation limits ----------------------------------------------------------------------------------
EXPIRING_DAYS = 30
CPE_LOOKUP_TTL_DAYS = 7
CT_DEDUP_TTL_SECONDS = 86400
MIN_ASN_ROWS = 1000
DNS_EDGES = {
    "A": "RESOLVES_TO", "AAAA": "RESOLVES_TO", "CNAME": "CNAME_TO", "MX": "USES_MAIL_SERVER",
    "NS": "USES_NAMESERVER",
}
DNS_CHANGES = {
    "A": "A_CHANGED", "AAAA": "AAAA_CHANGED", "CNAME": "CNAME_CHANGED", "MX": "MX_CHANGED", "NS": "NS_CHANGED",
    "TXT": "DNS_CHANGED",
}
SPECULATIVE_MODULES = ("speculate",)
