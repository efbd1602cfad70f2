"""Input schemas as DDL.  Loosely typed fields are strings and are cast where they are used, so that an unexpected
type costs one field and not the record."""

HTTP_RECORD = (
    "timestamp string, port string, url string, input string, title string, scheme string, webserver string, "
    "content_type string, method string, host string, host_ip string, path string, time string, a array<string>, "
    "aaaa array<string>, cname array<string>, tech array<string>, status_code int, content_length bigint, "
    "failed boolean, cdn boolean, cdn_name string, cdn_type string, favicon string, location string"
)
TLS_RECORD = (
    "timestamp string, host string, ip string, port string, probe_status boolean, tls_version string, cipher string, "
    "self_signed boolean, mismatched boolean, expired boolean, not_before string, not_after string, subject_dn string, "
    "subject_cn string, subject_an array<string>, serial string, issuer_dn string, issuer_cn string, "
    "issuer_org array<string>, fingerprint_hash struct<sha256:string>, sni string"
)
CRAWL_RECORD = (
    "timestamp string, request struct<method:string,endpoint:string,source:string,tag:string,attribute:string>, "
    "response struct<status_code:int>"
)
FINDING_RECORD = (
    "`template-id` string, `template-path` string, info struct<name:string,author:array<string>,tags:array<string>,"
    "description:string,reference:array<string>,severity:string,classification:struct<`cve-id`:array<string>,"
    "`cwe-id`:array<string>,`cvss-metrics`:string,`cvss-score`:double>>, type string, host string, port string, "
    "scheme string, url string, path string, `matched-at` string, `matcher-name` string, "
    "`extracted-results` array<string>, ip string, timestamp string, `curl-command` string, `matcher-status` boolean"
)
SEARCH_RECORD = "source string, ip string, host string, port int"
DISCOVERY_RECORD = (
    "type string, module string, id string, parent string, host string, data string, "
    "data_json struct<asn:string,technology:string>, resolved_hosts array<string>, scope_distance int, "
    "tags array<string>, discovery_context string"
)
CT_MESSAGE = (
    "message_type string, data struct<update_type:string,leaf_cert:struct<subject:struct<aggregated:string,CN:string>,"
    "extensions:struct<subjectAltName:string>,not_before:double,not_after:double,serial_number:string,"
    "fingerprint:string,sha1:string,sha256:string,all_domains:array<string>,issuer:struct<aggregated:string,CN:string,"
    "O:string>>,cert_index:bigint,seen:double,source:struct<url:string,name:string>>"
)
KEV_CATALOG = (
    "catalogVersion string, vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,"
    "vulnerabilityName:string,dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string,requiredAction:string,"
    "shortDescription:string,notes:string,cwes:array<string>>>"
)
_METRIC = (
    "array<struct<type:string,baseSeverity:string,cvssData:struct<baseScore:double,vectorString:string,"
    "baseSeverity:string>>>"
)
CVE_RECORD = (
    "id string, published string, lastModified string, vulnStatus string, "
    "descriptions array<struct<lang:string,value:string>>, "
    f"metrics struct<cvssMetricV40:{_METRIC},cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>, "
    "weaknesses array<struct<description:array<struct<lang:string,value:string>>>>"
)
# the parts of an event document that routing, notification and the panels look at
EVENT = (
    "`@timestamp` string, event struct<kind:string,category:string,type:string,action:string>, "
    "bb struct<index:string,doc_id:string,schema_version:string>, program struct<id:string,name:string>, "
    "scope struct<id:string,status:string>, asset struct<id:string,type:string,value:string>, "
    "scan struct<id:string,job_id:string,tool:string,tool_version:string>, source struct<name:string,type:string>, "
    "change struct<type:string,field:string,previous:string,current:string>, "
    "error struct<type:string,message:string,retry_count:int>, confidence struct<score:double,source:string>"
)

# stored tables
ASSETS = (
    "asset_type string, value string, status string, lifecycle_stage string, first_seen timestamp, last_seen timestamp, confidence_score double, "
    "confidence_source string, confidence_reason string, last_scanned timestamp, last_changed timestamp"
)
EDGES = (
    "source_id string, target_id string, relationship_type string, source string, confidence double, metadata string, first_seen timestamp, "
    "last_seen timestamp"
)
LINKS = "program_id string, asset_id string, status string, scope_id string, scope_reason string, first_seen timestamp, last_seen timestamp"
EVENTS = "seq long, ts timestamp, index string, ym string, doc_id string, kind string, category string, type string, payload string"
EVENT_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
