"""Registered queries of readers, XML normalisation, dimensions, bundles and streams.

Each writes texts that it makes from the driver's tables to the shared folder and reads them back by
the operator, so its work grows with the tables; the SQL tells what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors as D
from ..operators import merge as M
from ..operators import normalize as R
from ..operators.sigma import rule_table
from ..operators.stats import severity_summary
from ..operators.timeline import timeline
from ..schema import as_events
from ..sources import readers as B
from ..sources import sinks as X
from ..storage import new_path
from ..streaming import jobs as J
from .queries import BS, DAY, SETTINGS, query, scalar, table


def lines(df: DataFrame, one_a_file: bool = False) -> str:
    """Writes the one text column of ``df`` as lines, or as a file for each row."""
    path = new_path(df.sparkSession, "lines")
    (df.write.option("maxRecordsPerFile", 1) if one_a_file else df.write).text(path)
    return path


# Event XML. The same values go in as XML and are expected as columns.

def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def data(name: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f'<Data Name="{name}">'), escaped(c.cast("string")), F.lit("</Data>")), F.lit(""))


def event_xml(ev: DataFrame) -> DataFrame:
    """row_id and the XML of each event, with the property names that its provider uses."""
    c, eid = F.col, F.col("event_id")
    only = lambda ids, value: F.when(eid.isin(*ids), value)
    sysmon, shell = (1, 3, 22), (4104,)
    user = F.concat(F.lit("LAB" + BS), c("user_name"))
    parts = [
        data("TargetUserName", c("target_user_name")), data("TargetDomainName", only((4624, 4625, 4648, 4776), F.lit("LAB"))),
        data("SubjectUserName", F.when(~eid.isin(*sysmon, *shell, 7045), c("user_name"))), data("SubjectDomainName", only((4672, 4688, 4720, 4728, 4732, 1102), F.lit("LAB"))),
        data("MemberName", F.try_element_at("properties", F.lit("membername"))), data("IpAddress", F.when(~eid.isin(*sysmon), c("source_ip"))), data("LogonType", c("logon_type")),
        data("NewProcessName", only((4688,), c("process_path"))), data("NewProcessId", only((4688,), F.concat(F.lit("0x"), F.lower(F.hex("row_id"))))),
        data("ParentProcessName", only((4688,), F.concat(F.lit("C:" + BS), c("parent_process_name")))), data("CommandLine", only((4688, 1), c("command_line"))),
        data("User", only(sysmon, user)), data("Image", only((1, 3), c("process_path"))), data("ParentImage", only((1,), F.concat(F.lit("D:" + BS + "x" + BS), c("parent_process_name")))),
        data("ProcessId", only((1, 3), c("process_id"))), data("SourceIp", only((3,), c("source_ip"))), data("DestinationIp", c("destination_ip")), data("QueryName", c("query_name")),
        data("ScriptBlockText", c("script_block")), data("ContextInfo", only(shell, F.concat(F.lit("Host Application = powershell.exe\nUser = "), user, F.lit("\nno value =\n")))),
        data("TaskName", c("task_name")), data("TaskContent", only((4698,), c("command_line"))), data("ServiceName", c("service_name")), data("ImagePath", only((7045,), c("process_path"))),
        data("AccountName", only((7045,), c("user_name"))), F.lit("<Data>first</Data><Data></Data><Data>third</Data>"),
    ]
    head = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="'), c("provider_name"), F.lit('"/><EventID Qualifiers="7">'), eid.cast("string"),
        F.lit("</EventID><Level>"), (c("row_id") % 7).cast("string"), F.lit('</Level><TimeCreated SystemTime="'), F.date_format("time_created_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'1Z'"), F.lit('"/><EventRecordID>'),
        c("event_record_id").cast("string"), F.lit("</EventRecordID><Channel>"), c("log_name"), F.lit("</Channel><Computer>"), c("computer_name"), F.lit('</Computer><Security UserID="S-1-5-18"/></System>'),
    )
    extra = F.when(eid == 1102, F.lit("<UserData><Cleared xmlns='x'><Reason>a &amp; b</Reason><TargetUserName>never</TargetUserName><LogonType>2</LogonType><logonType>3</logonType></Cleared></UserData>")).otherwise("")
    broken = F.when(c("row_id") % 10 == 0, F.lit("<Event><System>")).otherwise(F.concat(head, F.lit("<EventData>"), F.concat(*parts), F.lit("</EventData>"), extra, F.lit("</Event>")))
    return ev.select("row_id", broken.alias("raw_xml"))


LEVEL_SQL = "CASE row_id % 7 WHEN 0 THEN 'LogAlways' WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' WHEN 5 THEN 'Verbose' ELSE '6' END"
SENT_SQL = "FROM e WHERE row_id % 10 <> 0"


@query("nrm1_parse_xml", f""" SELECT event_record_id, log_name, provider_name, event_id, CAST(us AS BIGINT) AS us, {LEVEL_SQL} AS level, computer_name, CASE WHEN event_id = 1102 THEN 'never' ELSE target_user_name END AS target, 'first' AS data0, 'third' AS data2,
 CASE WHEN event_id = 1102 THEN 'a & b' END AS reason, 'S-1-5-18' AS sid, '7' AS qualifiers, p_membername AS member {SENT_SQL}""")
def _(ev):
    d = R.parse_event_xml(event_xml(ev))
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return d.select("event_record_id", "log_name", "provider_name", "event_id", F.unix_micros("time_created_utc").alias("us"), "level", "computer_name", p("targetusername").alias("target"), p("data0").alias("data0"),
                    p("data2").alias("data2"), p("reason").alias("reason"), p("securityuserid").alias("sid"), p("eventidqualifiers").alias("qualifiers"), p("membername").alias("member"))


def odd_xml(ev: DataFrame) -> DataFrame:
    """Events whose data are nested, prefixed, in character data sections, by reference, unnamed or not Data at all."""
    n = F.col("row_id").cast("string")
    parts = [
        F.lit('<e:Event xmlns:e="x"><e:System><e:EventID>'), F.col("event_id").cast("string"), F.lit("</e:EventID><e:EventRecordID>"), n, F.lit("</e:EventRecordID></e:System>"),
        F.lit('<e:EventData><Data Name="A">first</Data><Data> </Data><Data Name=" ">'), n, F.lit("</Data><Param1>p"), n, F.lit('</Param1><Binary>AAEC</Binary><Data Name="a">'), F.col("computer_name"), F.lit("</Data></e:EventData>"),
        F.lit('<UserData><U k="v"><B x="1"><![CDATA[a<b '), n, F.lit("]]></B><N><M>deep &#65;&#x42;</M><M>late</M></N><Param1>no</Param1></U></UserData></e:Event>"),
    ]
    return ev.select(F.concat(*parts).alias("raw_xml"))


@query("nrm1b_odd_shapes", """ SELECT row_id AS event_record_id, event_id, computer_name AS a, CAST(row_id AS VARCHAR) AS data1, 'p' || row_id AS param1, 'a<b ' || row_id AS b, 'late' AS m, 'deep AB' AS n_m,
 CAST(6 AS BIGINT) AS properties FROM e""")
def _(ev):
    d = R.parse_event_xml(odd_xml(ev))
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return d.select("event_record_id", "event_id", p("a").alias("a"), p("data1").alias("data1"), p("param1").alias("param1"), p("b").alias("b"), p("m").alias("m"), p("n.m").alias("n_m"), F.size("properties").cast("long").alias("properties"))


#: What the field mapping makes of each event.
MAPPED_SQL = """event_record_id, event_id, CASE WHEN event_id IN (4624, 4625, 4648, 4776, 4771, 4769) THEN target_user_name ELSE user_name END AS user_name,
 CASE WHEN event_id NOT IN (104, 4698, 7045, 4769, 4771) THEN 'LAB' END AS domain, CASE WHEN event_id = 1102 THEN 'never' ELSE target_user_name END AS target_user_name, CASE WHEN event_id = 4104 THEN 'powershell.exe' WHEN event_id = 7045 THEN substr(process_path, 21 - CASE WHEN contains(process_path, 'Temp') THEN 12 ELSE 0 END) ELSE process_name END AS process_name,
 CASE WHEN event_id = 4104 THEN 'powershell.exe' ELSE process_path END AS process_path, parent_process_name, CASE event_id WHEN 4104 THEN 'powershell.exe' WHEN 7045 THEN process_path ELSE command_line END AS command_line,
 source_ip, destination_ip, CASE WHEN event_id = 1102 THEN 3 ELSE logon_type END AS logon_type, CASE WHEN event_id = 4688 THEN row_id WHEN event_id IN (1, 3) THEN process_id END::INTEGER AS process_id, query_name, task_name, service_name, script_block"""
MAPPED = ("event_record_id", "event_id", "user_name", "domain", "target_user_name", "process_name", "process_path", "parent_process_name", "command_line", "source_ip", "destination_ip", "logon_type", "process_id", "query_name", "task_name", "service_name", "script_block")


@query("nrm4_map_fields", f" SELECT {MAPPED_SQL} {SENT_SQL}")
def _(ev):
    return R.map_fields(R.parse_event_xml(event_xml(ev))).select(*MAPPED)


scalar("nrm5_context_info", "concat('Host Name = ', event_type, chr(13), chr(10), 'Empty =', chr(10), ' = none', chr(10), 'Severity=a=b', chr(10), 'host name =  last ', CAST(event_id AS STRING))", lambda: F.concat_ws("|", F.element_at(R.context_info(F.col("x")), "host name"), F.element_at(R.context_info(F.col("x")), "severity"), F.size(R.context_info(F.col("x"))).cast("string")),
       "concat('last ', CAST(event_id AS VARCHAR), '|a=b|2')")


@query("nrm8_fallback", """ SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'new' || row_id WHEN 1 THEN 'tgt' || row_id WHEN 2 THEN 'sub' || row_id END AS user_name, CASE row_id % 4 WHEN 0 THEN 'new' || row_id WHEN 1 THEN 'tgt' || row_id END AS target_user_name,
 CASE row_id % 4 WHEN 3 THEN 'ACC' END AS domain, '10.1.0.' || (row_id % 9) AS source_ip, 'app' || row_id || '.exe' AS process_name, 'par.exe' AS parent_process_name, CAST(row_id % 1000 AS INTEGER) AS source_port FROM e""")
def _(ev):
    """An unknown event id: the general names of each field, in their order."""
    n = F.col("row_id").cast("string")
    k = F.col("row_id") % 4
    pairs = [("newaccountname", F.when(k == 0, F.concat(F.lit("new"), n))), ("targetuser", F.when(k == 1, F.concat(F.lit("tgt"), n))), ("subjectusername", F.when(k < 3, F.concat(F.lit("sub"), n))), ("accountdomain", F.when(k == 3, "ACC")),
             ("sourceaddress", F.when(k < 2, F.concat(F.lit("10.1.0."), (F.col("row_id") % 9).cast("string")))), ("clientaddress", F.concat(F.lit("10.1.0."), (F.col("row_id") % 9).cast("string"))), ("targetusername", F.lit(" - ")),
             ("application", F.concat(F.lit("C:" + BS + "app"), n, F.lit(".exe"))), ("parentimage", F.lit("C:/x/par.exe")), ("ipport", (F.col("row_id") % 1000).cast("string"))]
    bag = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(a).alias("k"), b.alias("v")) for a, b in pairs)), lambda x: x["v"].isNotNull()))
    d = ev.select("row_id", F.lit(9999).alias("event_id"), F.lit("Some provider").alias("provider_name"), bag.alias("properties"))
    return R.map_fields(d).select("row_id", "user_name", "target_user_name", "domain", "source_ip", "process_name", "parent_process_name", "source_port")


@query("src1_event_xml", f" SELECT event_record_id, event_id, computer_name, lower(concat_ws('|', computer_name, log_name, provider_name, CAST(event_id AS VARCHAR), 'record:' || CAST(event_record_id AS VARCHAR))) AS event_key, CAST(us AS BIGINT) AS us {SENT_SQL}")
def _(ev):
    path = lines(event_xml(ev).select("raw_xml").withColumn("raw_xml", F.replace("raw_xml", F.lit("\n"), F.lit("&#10;"))))
    return B.read_event_xml(ev.sparkSession, path, whole_files=False).select("event_record_id", "event_id", "computer_name", "event_key", F.unix_micros("time_created_utc").alias("us"))


@query("src2_written_events", " SELECT row_id, event_id, strftime(time_created_utc, '%Y-%m-%d') AS day, coalesce(p_membername, p_status) AS bag FROM e")
def _(ev):
    path = new_path(ev.sparkSession, "events")
    B.write_events(R.with_identity(ev), path)
    d = B.read_events(ev.sparkSession, path)
    return d.select("row_id", "event_id", F.date_format("event_date", "yyyy-MM-dd").alias("day"), F.coalesce(*(F.try_element_at("properties", F.lit(k)) for k in ("membername", "status"))).alias("bag"))


# Feeds, catalogues and rules.

def made(spark: SparkSession, sf_dir: str, name: str, *columns: Column) -> DataFrame:
    return table(spark, sf_dir, name).select(*columns)


def batches(df: DataFrame, key: str, item: Column, wrap: str) -> DataFrame:
    """JSON documents of about a hundred items each."""
    listed = df.groupBy(F.floor(F.col(key) / 100).alias("b")).agg(F.concat_ws(",", F.collect_list(F.to_json(item))).alias("v"))
    return listed.select(F.concat(F.lit(wrap.split("@")[0]), F.col("v"), F.lit(wrap.split("@")[1])).alias("value"))


@query("src3_ioc_json", "SELECT CASE c_custkey % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'sha256' ELSE 'user' END AS type, 'v' || c_custkey AS value, c_name AS comment, 'own' AS source FROM customer WHERE c_custkey % 4 <> 0", bare=True)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "color").when(k % 3 == 0, " IP ").when(k % 3 == 1, "SHA256").otherwise("user")
    item = F.struct(kind.alias("type"), F.concat(F.lit(" v"), k.cast("string"), F.lit(" ")).alias("value"), F.col("c_name").alias("comment"), F.lit("own").alias("source"))
    return B.read_ioc_json(spark, lines(batches(table(spark, sf_dir, "customer"), "c_custkey", item, "[@]"), True)).select("type", "value", "comment", "source")


@query("src4_ioc_text", "SELECT CASE WHEN c_custkey % 5 = 1 THEN 'domain' ELSE 'ip' END AS type, CASE WHEN c_custkey % 5 = 1 THEN 'h' || c_custkey || '.test' ELSE '10.2.' || (c_custkey // 250) || '.' || (c_custkey % 250) END AS value FROM customer WHERE c_custkey % 5 <> 0", bare=True)
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    address = F.concat(F.lit("10.2."), F.floor(k / 250).cast("string"), F.lit("."), (k % 250).cast("string"))
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), n)).when(k % 5 == 1, F.concat(F.lit("127.0.0.1  h"), n, F.lit(".test"))).when(k % 5 == 2, F.concat(address, F.lit(", seen"))).otherwise(F.concat(F.lit(" "), address))
    return B.read_ioc_text(spark, lines(made(spark, sf_dir, "customer", line)), "ip", "feed").select("type", "value")


@query("src5_ioc_url_csv", "SELECT unnest(['url', 'domain']) AS type, unnest(['http://h' || c_custkey || '.test/p?q=' || c_custkey, 'h' || c_custkey || '.test']) AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'url', 'https://local' || c_custkey || '/x' FROM customer WHERE c_custkey % 3 = 0", bare=True)
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://local"), n, F.lit("/x"))).otherwise(F.concat(F.lit("http://h"), n, F.lit(".test/p?q="), n))
    rows = made(spark, sf_dir, "customer", F.concat(F.lit('"'), n, F.lit('","'), url, F.lit('","online"')).alias("value"))
    comments = made(spark, sf_dir, "nation", F.concat(F.lit("# http://no.test/"), F.col("n_name")).alias("value"))
    return B.read_ioc_url_csv(spark, lines(rows.unionByName(comments)), "feed").select("type", "value")


@query("src6_ioc_cidr", "SELECT 'ip' AS type, '10.' || (c_custkey // 250) || '.' || (c_custkey % 250) || '.0' AS value FROM customer WHERE c_custkey % 7 <> 0", bare=True)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    net = F.concat(F.lit("10."), F.floor(k / 250).cast("string"), F.lit("."), (k % 250).cast("string"), F.lit(".0/24"))
    line = F.when(k % 7 == 0, "not-json").otherwise(F.to_json(F.struct(net.alias("cidr"), F.lit("x").alias("rir"))))
    return B.read_ioc_cidr_ndjson(spark, lines(made(spark, sf_dir, "customer", line)), "feed").select("type", "value")


@query("src7_ioc_mixed", "SELECT CASE c_custkey % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'hash' WHEN 2 THEN 'url' ELSE 'domain' END AS type, CASE c_custkey % 4 WHEN 0 THEN '10.3.4.' || (c_custkey % 250) WHEN 1 THEN md5(c_name) WHEN 2 THEN 'HTTP://x.test/' || c_custkey ELSE 'd' || c_custkey || '.test' END AS value FROM customer", bare=True)
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    line = F.when(k % 4 == 0, F.concat(F.lit("10.3.4."), (k % 250).cast("string"))).when(k % 4 == 1, F.md5("c_name")).when(k % 4 == 2, F.concat(F.lit("HTTP://x.test/"), n)).otherwise(F.concat(F.lit(" d"), n, F.lit(".test ")))
    rows = made(spark, sf_dir, "customer", line.alias("value")).unionByName(made(spark, sf_dir, "nation", F.concat(F.lit("; "), F.col("n_name")).alias("value")))
    return B.read_ioc_mixed(spark, lines(rows), "feed").select("type", "value")


@query("src8_cve_catalog", "SELECT 'CVE-2024-' || c_custkey AS cve_id, 'Vendor ' || c_nationkey AS vendor_project, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') END AS added FROM customer WHERE c_custkey % 9 <> 0", bare=True)
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    day = F.when(k % 2 == 0, F.concat(F.lit("2024-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))).otherwise("soon")
    item = F.struct(F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" cve-2024-"), n)).alias("cveID"), F.concat(F.lit("Vendor "), F.col("c_nationkey").cast("string")).alias("vendorProject"), day.alias("dateAdded"))
    d = B.read_cve_catalog(spark, lines(batches(table(spark, sf_dir, "customer"), "c_custkey", item, '{"vulnerabilities":[@]}'), True))
    return d.select("cve_id", "vendor_project", F.date_format("date_added", "yyyy-MM-dd").alias("added"))


@query("src9_attack_bundle", "SELECT 'technique' AS kind, 'T' || c_custkey AS id, lower('Phase-' || c_nationkey) AS names FROM customer WHERE c_custkey % 5 > 1 UNION ALL SELECT 'tactic', 'TA' || c_custkey, 'short' || c_custkey FROM customer WHERE c_custkey % 5 = 1", bare=True)
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    tactic = k % 5 == 1
    own = F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.when(tactic, "TA").otherwise("t"), n).alias("external_id"), F.lit("u").alias("url"))
    other = F.struct(F.lit("else").alias("source_name"), F.lit("X").alias("external_id"), F.lit("u").alias("url"))
    phase = F.struct(F.concat(F.lit("Phase-"), F.col("c_nationkey").cast("string")).alias("phase_name"))
    item = F.struct(F.when(tactic, "x-mitre-tactic").otherwise("attack-pattern").alias("type"), F.col("c_name").alias("name"), F.when(tactic, F.concat(F.lit("Short"), n)).alias("x_mitre_shortname"), F.when(k % 5 == 0, True).alias("revoked"),
                    F.array(other, own).alias("external_references"), F.when(~tactic, F.array(phase, phase)).alias("kill_chain_phases"))
    techniques, tactics = B.read_attack_bundle(spark, lines(batches(table(spark, sf_dir, "customer"), "c_custkey", item, '{"objects":[@]}'), True))
    told = techniques.select(F.lit("technique").alias("kind"), F.col("technique_id").alias("id"), F.array_join("tactic_short_names", ",").alias("names"))
    return told.unionByName(tactics.select(F.lit("tactic").alias("kind"), F.col("tactic_id").alias("id"), F.col("short_name").alias("names")))


def csv(df: DataFrame) -> str:
    path = new_path(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return path


@query("src10_titles_aliases", "SELECT 'Security' AS a, CAST(c_custkey AS VARCHAR) AS b, 'Title ' || c_name AS c FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT 'alias' || c_custkey, 'Leaf' || c_custkey, NULL FROM customer WHERE c_custkey % 4 <> 0", bare=True)
def _(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    titles = made(spark, sf_dir, "customer", F.lit(" Security").alias("Channel"), F.when(k % 6 == 0, "x").otherwise(n).alias("EventID"), F.concat(F.lit("Title "), F.col("c_name")).alias("EventTitle"))
    aliases = made(spark, sf_dir, "customer", F.concat(F.lit("alias"), n).alias("alias"), F.when(k % 4 == 0, "Event.").otherwise(F.concat(F.lit("Event.EventData.Leaf"), n)).alias("path"))
    t = B.read_event_titles(spark, csv(titles)).select(F.col("channel").alias("a"), F.col("event_id").cast("string").alias("b"), F.col("title").alias("c"))
    return t.unionByName(B.read_field_aliases(spark, csv(aliases)).select(F.col("alias").alias("a"), F.col("leaf").alias("b"), F.lit(None).cast("string").alias("c")))


@query("src11_rules", "SELECT 'r' || n_nationkey AS rule_id, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'High' ELSE 'Medium' END AS severity, 'attack.t' || (1000 + n_nationkey) AS mitre_technique FROM nation WHERE n_nationkey % 5 <> 0", bare=True)
def _(spark, sf_dir):
    k, n = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    head = F.concat(F.lit("title: "), F.col("n_name"), F.lit("\nid: r"), n, F.when(k % 2 == 0, "\nlevel: high").otherwise(""), F.lit("\ntags: [attack.impact, attack.t"), (k + 1000).cast("string"), F.lit("]\n"))
    text = F.concat(head, F.when(k % 5 == 0, "detection: {").otherwise("detection:\n  s: {EventID: 1}\n  condition: s\n"))
    rules = B.load_rules(spark, [lines(made(spark, sf_dir, "nation", text), True)])
    return rule_table(spark, rules).select("rule_id", "title", "severity", "mitre_technique")


# Dimensions.

@query("mrg4_replace_all", "SELECT 'ip' AS type, c_name AS value FROM customer", bare=True)
def _(spark, sf_dir):
    path = new_path(spark, "indicators")
    row = lambda kind: made(spark, sf_dir, "customer", F.lit(kind).alias("type"), F.col("c_name").alias("value"))
    for kind in ("old", "ip"):
        M.replace_all(row(kind), path)
    return spark.read.parquet(path)


@query("mrg5_attack_dimension", "SELECT 'T' || c_nationkey AS technique_id, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_nationkey", bare=True)
def _(spark, sf_dir):
    k = F.col("c_nationkey").cast("string")
    d = made(spark, sf_dir, "customer", F.concat(F.when(F.col("c_custkey") % 2 == 0, "attack.t").otherwise(" T"), k).alias("technique_id"), F.col("c_name").alias("name"), "c_custkey")
    first = M.first_per_key(d, T.normalize_technique_id(F.col("technique_id")), "c_custkey")
    return first.select(T.normalize_technique_id(F.col("technique_id")).alias("technique_id"), "name")


@query("d8_preview", " SELECT row_id AS event_row_id, 'IEX (New-Obj' AS preview FROM e WHERE event_id IN (1, 4688, 4104) AND contains(concat_ws('|', command_line, script_block), '-enc SQBFAFgA')")
def _(ev):
    found = D.suspicious_powershell(ev).where(F.contains("details", F.lit("; preview=")))
    return found.select("event_row_id", F.regexp_extract("details", "; preview=(.*)$", 1).alias("preview"))


# The bundle, written and read again.

@query("snk5_bundle", f""" SELECT 'timeline-json' AS name, CAST(row_id AS VARCHAR) AS a, computer_name AS b FROM e
 UNION ALL SELECT 'timeline-csv', CAST(row_id AS VARCHAR), computer_name FROM e UNION ALL SELECT 'findings-parquet', CAST(row_id AS VARCHAR), 'ServiceInstallation' FROM e WHERE event_id = 7045
 UNION ALL SELECT 'summary-json', 'Findings', CAST(count(*) AS VARCHAR) FROM e WHERE event_id = 7045""")
def _(ev):
    spark, base = ev.sparkSession, new_path(ev.sparkSession, "bundle")
    f = D.service_installs(ev)
    none = f.limit(0)
    tables = {"timeline": X.export_timeline(timeline(ev, f)), "findings": f, "summary": severity_summary(f, none, none, none).where("key = 'Findings'")}
    for fmt in ("json", "csv", "parquet"):
        X.write_investigation(tables, f"{base}/{fmt}", fmt)
    row = lambda name, d, a, b: d.select(F.lit(name).alias("name"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    out = row("timeline-json", spark.read.schema("eventRowId bigint, host string").json(f"{base}/json/timeline"), "eventRowId", "host")
    out = out.unionByName(row("timeline-csv", spark.read.option("header", True).csv(f"{base}/csv/timeline"), "EventRowId", "Host"))
    out = out.unionByName(row("findings-parquet", spark.read.parquet(f"{base}/parquet/findings"), "event_row_id", "rule_id"))
    return out.unionByName(row("summary-json", spark.read.schema("key string, value bigint").json(f"{base}/json/summary"), "key", "value"))


# Streams: what is there is read to its end, as in batches.

def arrived(ev: DataFrame) -> str:
    path = new_path(ev.sparkSession, "arrived")
    as_events(ev).write.parquet(path)
    return path


@query("str1_collect", f" SELECT row_id, lower(concat_ws('|', computer_name, log_name, provider_name, CAST(event_id AS VARCHAR), 'record:' || CAST(event_record_id AS VARCHAR))) AS event_key, user_name, command_line FROM e")
def _(ev):
    spark, target = ev.sparkSession, new_path(ev.sparkSession, "collected")
    source = arrived(ev)
    for _ in range(2):  # the second run sees poorer copies of the same events, which change nothing
        J.collect_incrementally(R.with_identity(J.stream_events(spark, source)), target, f"{target}_at").awaitTermination()
        as_events(ev.where("row_id % 9 = 0")).withColumn("command_line", F.lit(None).cast("string")).write.mode("append").parquet(source)
    return J.collected(spark, target).select("row_id", "event_key", "user_name", "command_line")


@query("str2_stateless_findings", " SELECT 'LogClearing' AS rule_id, CASE WHEN event_id = 1102 THEN 'Critical' ELSE 'High' END AS severity, row_id AS event_row_id FROM e WHERE event_id IN (104, 1102) UNION ALL SELECT 'ServiceInstallation', 'Medium', row_id FROM e WHERE event_id = 7045")
def _(ev):
    spark, target = ev.sparkSession, new_path(ev.sparkSession, "found")
    found = J.stream_findings(J.stream_events(spark, arrived(ev)), SETTINGS, {"log_clearing": D.log_clearing, "service_installs": D.service_installs})
    found.writeStream.format("parquet").option("checkpointLocation", f"{target}_at").trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(found.schema).parquet(target).select("rule_id", "severity", "event_row_id")


@query("str3_windows", f""", f AS (SELECT account, ip, us FROM e WHERE event_id = 4625), k AS (SELECT account, ip, unnest(range(us - us % {DAY} - {6 * DAY}, us - us % {DAY} + 1, {DAY})) AS start_us FROM f)
 SELECT account, ip, CAST(start_us AS BIGINT) AS start_us, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY account, ip, start_us HAVING count(*) >= 3""")
def _(ev):
    """Sliding windows of a week that begin every day; the last state of each is kept."""
    spark, target = ev.sparkSession, new_path(ev.sparkSession, "windows")
    counted = J.failed_logon_windows(J.stream_events(spark, arrived(ev)), 3, "7 days", "1 day", "30 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{target}_at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(target).select("account", "ip", F.unix_micros("start").alias("start_us"), "n")

