"""Detectors: each turns events and settings into finding rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.accounts import account_key, in_suspicious_path, ip_key, is_machine_account, is_privileged_group, suspicious_paths
from ..functions.text import blank, contains_any, contains_ci, decode_base64_preview, equals_ci
from ..schema import RANK, first_prop, is_sysmon, micros, once, prop
from ..storage import stored
from .findings import PRIMARY, declared_ids_sql, make_finding, provider_has, sql_text
from .signature_catalog import CATALOGS, Signature
from .containment import containing
from .windows import busy_runs, cluster_rows, distinct_ahead, first_after, greedy_clusters, window_ends

MINUTE = 60_000_000

# Word lists of the script detector.
HIDDEN = ("-w hidden", "-windowstyle hidden", "-window hidden", "-noprofile", " -nop ")
BYPASS = ("-ep bypass", "-executionpolicy bypass", "executionpolicy bypass", "-ep unrestricted")
DOWNLOAD = (
    "downloadstring", "downloadfile", "invoke-webrequest", "invoke-restmethod", "net.webclient", "system.net.webclient", "httpclient", "webrequest", "wget ",
    "curl ", "bitsadmin", "start-bitstransfer", "certutil", "invoke-expression", "iex(", "iex ", "start-process", "new-object net.webclient",
)
OBFUSCATION = (
    "frombase64string", "tochararray", "char[]", "[char]", "-join", "invoke-obfuscation", "encodedcommand", "compress-archive", "decompress", "gzipstream",
    "deflatestream", "reflection.assembly", "load(byte[]",
)
INJECTION = (
    "virtualalloc", "virtualallocex", "writeprocessmemory", "createremotethread", "ntunmapviewofsection", "rtlmovememory", "marshal.copy",
    "getdelegateforfunctionpointer", "invoke-reflectivepeinjection", "invoke-shellcode",
)
#: Characters that are shown of a decoded command.
PREVIEW = 200
ENCODED = r"""(?i)(-enc|-encodedcommand|-ec)(\s+|:)\s*(?:['"])?([A-Za-z0-9+/]{20,}={0,2})"""
LONG_BASE64 = r"[A-Za-z0-9+/]{80,}={0,2}"
REPLICATION_GUIDS = ("1131f6aa-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2", "89e95b76-444d-4c62-991a-0facbeda640c")
PARENT_CHILD = (
    ("winword.exe", "powershell.exe"), ("winword.exe", "cmd.exe"), ("excel.exe", "powershell.exe"), ("excel.exe", "cmd.exe"), ("outlook.exe", "powershell.exe"),
    ("outlook.exe", "cmd.exe"), ("wmiprvse.exe", "powershell.exe"), ("services.exe", "cmd.exe"), ("winword.exe", "mshta.exe"), ("winword.exe", "wscript.exe"),
    ("excel.exe", "mshta.exe"), ("outlook.exe", "rundll32.exe"), ("acrord32.exe", "powershell.exe"), ("w3wp.exe", "cmd.exe"), ("w3wp.exe", "powershell.exe"),
    ("sqlservr.exe", "cmd.exe"), ("sqlservr.exe", "powershell.exe"), ("spoolsv.exe", "cmd.exe"), ("svchost.exe", "whoami.exe"),
)
PROCESS_PATHS = ("\\Temp\\", "\\AppData\\Local\\Temp\\", "\\Downloads\\", "\\Загрузки\\", "\\Документы\\", "\\Рабочий стол\\")
TASK_PATHS = ("\\Temp\\", "\\AppData\\", "\\Downloads\\", "\\Загрузки\\", "\\Документы\\", "\\Рабочий стол\\")


@dataclass(frozen=True)
class Settings:
    failed_logon_threshold: int = 3
    burst_threshold: int = 5
    spray_threshold: int = 5
    burst_window_us: int = 5 * MINUTE
    new_user_window_us: int = 10 * MINUTE
    long_command: int = 500
    long_base64: int = 80
    process_paths: tuple[str, ...] = PROCESS_PATHS
    task_paths: tuple[str, ...] = TASK_PATHS
    parent_child: tuple[tuple[str, str], ...] = PARENT_CHILD
    groups: tuple[str, ...] = ()
    signatures: dict[str, tuple[Signature, ...]] = field(default_factory=lambda: dict(CATALOGS))
    sample_ids: int = 2


def _named(events: DataFrame) -> DataFrame:
    """Keys and times that the logon detectors group by."""
    return events.withColumns({"account": account_key(), "ip": ip_key(), "us": micros()})


def has_user() -> Column:
    return F.coalesce("target_user_name", "user_name", F.lit("")) != ""


def is_failure() -> Column:
    status = prop("Status")
    failed = (status != "") & ~F.lower(status).isin("0", "0x0", "0x00000000")
    return F.coalesce(F.col("event_id").isin(4625, 4771) | ((F.col("event_id") == 4776) & failed), F.lit(False))


def _last(columns=PRIMARY) -> Column:
    return F.max_by(F.struct(*columns), F.struct("us", "row_id"))


def _with_primary(groups: DataFrame, events: DataFrame, row: str) -> DataFrame:
    """Groups with the PRIMARY columns of the event that ``row`` names. Only those events are shuffled."""
    g = stored(groups, "window-groups")
    ids = g.select(F.col(row).alias("_row")).distinct()
    side = events.select(*PRIMARY).join(ids, F.col("row_id") == F.col("_row"), "left_semi").dropDuplicates(["row_id"])
    return g.join(side, F.col(row) == F.col("row_id")).drop(row)


def _group_findings(d: DataFrame, keys: list[str], rule: str, title: Column, severity, description, details, least: int = 1, more: dict | None = None) -> DataFrame:
    """One finding for each group: everything is an aggregate, so hot groups are reduced before the shuffle."""
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), _last().alias("p"),
        F.min_by(F.struct("row_id", F.coalesce("target_user_name", "user_name").alias("who"), "workstation_name"), F.struct("us", "row_id")).alias("f"),
        *(e.alias(k) for k, e in (more or {}).items()),
    ).where(F.col("n") >= least)
    g = g.select(*keys, "n", "first_us", "last_us", "f", *(more or {}), "p.*")
    return make_finding(g, rule, title, severity, description, details, related=F.array("f.row_id", "row_id"), count=F.col("n"), group_key=F.concat_ws("|", *keys), first_us=F.col("first_us"), last_us=F.col("last_us"))


def failed_logons(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    d = _named(events.where((F.col("event_id") == 4625) & has_user()))
    text = F.concat(F.col("n").cast("string"), F.lit(" failed logon events (4625) for the same account and source IP."))
    details = F.concat(F.lit("account="), F.col("account"), F.lit("; ip="), F.col("ip"), F.lit("; count="), F.col("n").cast("string"))
    return _group_findings(d, ["account", "ip"], "FailedLogon", F.concat(F.lit("Failed logons for "), F.col("f.who")), RANK["Low"], text, details, max(1, s.failed_logon_threshold))


#: Titles that tell the groups of a rule apart.
SPRAYING, PRE_AUTH_BURST, ROASTING_BURST = "Possible password spraying", "Kerberos pre-authentication failure burst", "Kerberoasting ticket-request burst"
LOGON_TYPES = {3: "Network", 8: "NetworkCleartext", 9: "NewCredentials", 10: "RemoteInteractive (RDP)", 11: "CachedRemoteInteractive"}


def successful_logons(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    d = _named(events.where((F.col("event_id") == 4624) & F.col("logon_type").isin(*LOGON_TYPES) & ~is_machine_account()))
    name = F.lit(None).cast("string")
    for t, n in LOGON_TYPES.items():
        name = F.when(F.col("logon_type") == t, F.lit(n)).otherwise(name)
    rank = F.when(F.col("logon_type").isin(8, 10), RANK["Low"]).otherwise(RANK["Info"])
    details = F.concat(F.lit("count="), F.col("n").cast("string"), F.lit("; logonType="), F.col("logon_type").cast("string"), F.lit("; ip="), F.col("ip"))
    remote = _group_findings(d, ["account", "logon_type", "ip"], "SuccessfulLogon", F.concat(F.lit("Successful "), name, F.lit(" logon: "), F.col("f.who")), rank, F.concat(F.lit("Remote logon from "), F.col("ip")), details)
    explicit = make_finding(events.where((F.col("event_id") == 4648) & ~is_machine_account()), "SuccessfulLogon", "Logon with explicit credentials", RANK["Low"], details=F.concat(F.lit("target="), F.coalesce("target_user_name", F.lit(""))))
    return remote.unionByName(explicit)


def rdp_activity(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    d = _named(events.where((F.col("event_id") == 4624) & (F.col("logon_type") == 10) & ~is_machine_account()))
    details = F.concat(F.lit("account="), F.col("account"), F.lit("; ip="), F.col("ip"), F.lit("; count="), F.col("n").cast("string"))
    return _group_findings(d, ["account", "ip"], "RdpActivity", F.concat(F.lit("RDP logon: "), F.col("f.who")), RANK["Low"], F.concat(F.col("n").cast("string"), F.lit(" RDP logons")), details)


def burst_clusters(events: DataFrame, window_us: int, threshold: int) -> DataFrame:
    """Greedy bursts of failures: account, ip, n, first_us, last_us, first_row, last_row (last failure), won_row
    (first 4624 of the same account and address within the window after it, or null)."""
    keys = ["account", "ip"]
    d = _named(events.where(is_failure() & has_user())).select(*keys, "us", "row_id")
    d = stored(window_ends(busy_runs(d, keys, window_us, threshold), keys, window_us), "window-events")
    clusters = greedy_clusters(d.where(F.col("end_rn") - F.col("rn") + 1 >= threshold).select(*keys, "run", "bucket", "rn", "end_rn"), keys)
    g = cluster_rows(d, clusters, keys).groupBy(*keys, "run", "start_rn").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("row_id", "rn").alias("last_row"), F.min_by("row_id", "rn").alias("first_row")
    )
    g = stored(g, "window-groups").withColumn("cluster", F.concat_ws("|", *keys, F.col("first_us").cast("string"), F.col("first_row").cast("string")))
    wins = _named(events.where(F.col("event_id") == 4624)).select(F.col("account").alias("s_account"), F.col("ip").alias("s_ip"), F.col("us").alias("s_us"), F.col("row_id").alias("s_row"))
    hit = first_after(g, wins, "cluster", [("account", "s_account"), ("ip", "s_ip")], F.col("last_us"), F.col("last_us") + window_us, "s_us", "s_row", window_us)
    return g.join(hit, "cluster", "left").select(*keys, "n", "first_us", "last_us", "first_row", "last_row", F.col("hit.id").alias("won_row"))


def brute_force(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    g = burst_clusters(events, s.burst_window_us, max(2, s.burst_threshold))
    g = g.withColumns({"won": F.col("won_row").isNotNull(), "p_row": F.coalesce("won_row", "last_row")}).drop("won_row")
    g = _with_primary(g, events.where(is_failure() | (F.col("event_id") == 4624)), "p_row")
    details = F.concat(F.lit("account="), F.col("account"), F.lit("; ip="), F.col("ip"), F.lit("; failures="), F.col("n").cast("string"))
    title = F.when(F.col("won"), "Possible successful brute force authentication").otherwise("Possible brute force authentication")
    return make_finding(
        g, "BruteForce", title, F.when(F.col("won"), RANK["High"]).otherwise(RANK["Medium"]), F.concat(F.col("n").cast("string"), F.lit(" failed logons in a window")), details,
        related=F.array("first_row", "last_row", "row_id"), count=F.col("n") + F.col("won").cast("int"), group_key=F.concat_ws("|", "account", "ip"), first_us=F.col("first_us"), last_us=F.col("last_us"),
    )


def spray_clusters(events: DataFrame, window_us: int, threshold: int) -> DataFrame:
    """Greedy windows of one address with failures for many accounts."""
    d = _named(events.where(is_failure() & has_user())).where(~F.col("ip").isin("", "-"))
    d = d.select("ip", "account", "us", "row_id").withColumn("named", F.when(F.regexp_replace("account", r"^\\+|\\+$", "") != "", F.col("account"))).drop("account")
    d = stored(window_ends(busy_runs(d, ["ip"], window_us, threshold), ["ip"], window_us), "window-events")
    d = stored(distinct_ahead(d, ["ip"], window_us, "named", "seen"), "window-values")
    clusters = greedy_clusters(d.where(F.col("seen") >= threshold).select("ip", "run", "bucket", "rn", "end_rn"), ["ip"])
    d = d.drop("seen")
    return cluster_rows(d, clusters, ["ip"]).groupBy("ip", "run", "start_rn").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("named").alias("n_accounts"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("row_id", "rn").alias("p_row"), F.min_by("row_id", "rn").alias("first_row")
    )


def password_spray(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    g = _with_primary(spray_clusters(events, s.burst_window_us, max(3, s.spray_threshold)).drop("run", "start_rn"), events.where(is_failure()), "p_row")
    details = F.concat(F.lit("ip="), F.col("ip"), F.lit("; attempts="), F.col("n").cast("string"), F.lit("; distinctAccounts="), F.col("n_accounts").cast("string"))
    return make_finding(g, "BruteForce", SPRAYING, RANK["High"], "Failures for many accounts from one source", details, related=F.array("first_row", "row_id"), count=F.col("n"), group_key=F.col("ip"), first_us=F.col("first_us"), last_us=F.col("last_us"))


def group_of() -> Column:
    named = prop("TargetUserName")
    return F.when(named != "", named).otherwise(F.coalesce("target_user_name", prop("GroupName")))


def group_sid() -> Column:
    sid = prop("TargetSid")
    return F.when(sid != "", sid).otherwise(prop("TargetUserSid"))


def _created(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_id") == 4720).withColumns({"us": micros(), "new_user": F.coalesce("target_user_name", prop("TargetUserName"))})


def _named_and_added(events: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Creations (row_id, us, name) and additions to privileged groups (g_row, g_us, name), one row for each name that they fit."""
    created = _created(events)
    adds = events.where(F.col("event_id").isin(4728, 4732, 4756)).where(is_privileged_group(prop("TargetUserName"), F.when(blank(prop("TargetSid")), prop("TargetUserSid")).otherwise(prop("TargetSid")), s.groups))
    adds = adds.select(F.col("row_id").alias("g_row"), micros().alias("g_us"), prop("MemberName").alias("g_member"), F.col("raw_xml").alias("g_raw"), F.col("target_user_name").alias("g_target"))
    adds = stored(adds.withColumn("g_text", F.concat_ws("\0", "g_member", "g_raw")), "group-additions")
    created = created.select("row_id", "us", F.lower(F.coalesce("new_user", F.lit(""))).alias("name"), F.col("new_user").isNull().alias("nameless"))
    # Names are looked up in the texts of additions, and meet creations by equality.
    told = containing(adds, "g_row", "g_text", created.select(F.col("name").alias("pattern"))).withColumnsRenamed({"g_row": "of_row", "pattern": "name"})
    same = adds.where("g_target is not null").select(F.col("g_row").alias("of_row"), F.lower("g_target").alias("name"))
    fits = adds.select("g_row", "g_us").join(told.unionByName(same).distinct(), F.col("g_row") == F.col("of_row"))
    return created.where("not nameless and us is not null").drop("nameless"), fits.where("g_us is not null").drop("of_row")


def _slot(c: str, s: Settings) -> Column:
    return F.floor(F.col(c) / s.new_user_window_us).cast("bigint")


def new_user_additions(events: DataFrame, s: Settings = Settings(), of: DataFrame | None = None) -> DataFrame:
    """(row_id, g_row, g_us): each creation and all that put the account into a privileged group within the window.

    ``of`` (row_id and more columns) limits creations and adds its columns before pairs are made, so pairs,
    which may be far more than events, are never shuffled.
    """
    created, fits = _named_and_added(events, s)
    if of is not None:
        created = created.join(of, "row_id")
    a = created.withColumn("slot", F.explode(F.array(_slot("us", s), _slot("us", s) + 1)))
    pairs = a.join(fits.withColumn("slot", _slot("g_us", s)), ["name", "slot"])
    return pairs.where(F.col("g_us").between(F.col("us"), F.col("us") + s.new_user_window_us)).drop("name", "slot", "us")


def new_user_hits(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(row_id, hits, hit_row, hit_us): number, least id and last time of the additions of each creation that has any.

    Pairs are never joined. A window holds the rest of its own slot of time and the beginning of the next, so
    a creation asks twice; asks and additions are sorted together, the own slot's from its end, and
    running aggregates answer. The work grows with creations plus additions.
    """
    created, fits = _named_and_added(events, s)
    item = lambda slot, late, at: F.struct(slot.alias("slot"), F.lit(late).alias("late"), at.alias("at"))
    both = lambda d, *items: d.withColumn("_item", F.explode(F.array(*items))).select("*", "_item.*").drop("_item")
    asks = both(created, item(_slot("us", s), True, -F.col("us")), item(_slot("us", s) + 1, False, F.col("us") + s.new_user_window_us)).drop("us")
    adds = both(fits, item(_slot("g_us", s), True, -F.col("g_us")), item(_slot("g_us", s), False, F.col("g_us")))
    so_far = W.partitionBy("name", "slot", "late").orderBy("at", F.col("row_id").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = asks.unionByName(adds, allowMissingColumns=True).select("row_id", F.count("g_row").over(so_far).alias("n"), F.min("g_row").over(so_far).alias("least"), F.max("g_us").over(so_far).alias("last"))
    return d.where("row_id is not null and n > 0").groupBy("row_id").agg(F.sum("n").alias("hits"), F.min("least").alias("hit_row"), F.max("last").alias("hit_us"))


def new_users(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Created accounts; High if a privileged group takes them in within the window."""
    created = _created(events)
    d = created.join(new_user_hits(events, s), "row_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    taken = F.col("hits") > 0
    details = F.concat(F.lit("newUser="), F.coalesce("new_user", F.lit("")), F.lit("; privilegedGroupEvents="), F.col("hits").cast("string"))
    return make_finding(
        d, "NewUser", F.when(taken, "New user created and added to a privileged group").otherwise("New user account created"), F.when(taken, RANK["High"]).otherwise(RANK["Medium"]),
        F.concat(F.lit("Account '"), F.coalesce("new_user", F.lit("")), F.lit("' was created.")), details, related=F.array_compact(F.array("row_id", "hit_row")), count=F.col("hits") + 1, first_us=F.col("us"), last_us=F.coalesce("hit_us", "us"),
    )


def privilege_changes(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    adds = events.where(F.col("event_id").isin(4728, 4732, 4756))
    inside = is_privileged_group(group_of(), group_sid(), s.groups) | is_privileged_group(F.col("raw_xml"), None, s.groups)
    member = first_prop("MemberName", "MemberSid")
    details = F.concat(F.lit("member="), member, F.lit("; group="), F.coalesce(group_of(), F.lit("")))
    grouped = make_finding(adds.where(inside), "PrivilegeChange", "User added to a privileged group", RANK["High"], F.concat(F.lit("Member '"), member, F.lit("' was added.")), details)
    special = events.where((F.col("event_id") == 4672) & ~is_machine_account())
    return grouped.unionByName(make_finding(special, "PrivilegeChange", "Special privileges assigned to new logon", RANK["Low"], details=prop("PrivilegeList")))


def is_process_start() -> Column:
    return (F.col("event_id") == 4688) | ((F.col("event_id") == 1) & is_sysmon())


def process_creation(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    path = F.coalesce("process_path", "command_line", "process_name", F.lit(""))
    pair = F.lit(False)
    for parent, child in s.parent_child:
        pair = pair | (equals_ci(F.col("parent_process_name"), parent) & equals_ci(F.col("process_name"), child))
    length = F.char_length("command_line")
    reasons = F.array_compact(F.array(
        F.when(in_suspicious_path(path, s.process_paths), "suspicious location"),
        F.when(length >= s.long_command, F.concat(F.lit("command line length "), length.cast("string"))),
        F.when(pair, F.concat(F.lit("unusual parent/child pair "), F.col("parent_process_name"), F.lit(" -> "), F.col("process_name"))),
    ))
    d = events.where(is_process_start()).withColumn("reasons", once(reasons)).where(F.size("reasons") > 0)
    rank = F.when(F.size("reasons") > 1, RANK["High"]).otherwise(RANK["Medium"])
    return make_finding(d, "SuspiciousProcessCreation", "Suspicious process creation", rank, F.array_join("reasons", "; "), F.concat(F.lit("image="), path))


def script_reasons(s: Settings = Settings()) -> Column:
    """What is suspicious in a script or command line (column ``blob``)."""
    low = F.lower("blob")
    encoded = F.col("blob").rlike(ENCODED)
    long_run = F.col("blob").rlike(LONG_BASE64) & (F.char_length("blob") >= s.long_base64)
    marks = sum((F.contains(low, F.lit(t)).cast("int") for t in OBFUSCATION), F.lit(0))
    return F.array_compact(F.array(
        F.when(encoded, "encoded command indicator").when(long_run, "unusually long Base64 string"),
        F.when(contains_any(low, HIDDEN), "hidden window / noprofile indicator"),
        F.when(contains_any(low, BYPASS), "execution policy bypass indicator"),
        F.when(contains_any(low, DOWNLOAD), "download-related keyword"),
        F.when(marks >= 2, "script obfuscation or in-memory assembly indicator"),
        F.when(contains_any(low, INJECTION), "process injection or shellcode indicator"),
    ))


def suspicious_powershell(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    d = events.where(F.col("event_id").isin(4103, 4104, 4688) | ((F.col("event_id") == 1) & is_sysmon()))
    parts = [F.when(~blank(F.col(c)), F.col(c)) for c in ("command_line", "script_block", "parent_command_line", "raw_xml")]
    d = d.withColumn("blob", once(F.concat_ws("\n", *parts))).withColumn("reasons", once(script_reasons(s))).where(F.size("reasons") > 0)
    rank = F.when(F.size("reasons") >= 2, RANK["High"]).otherwise(RANK["Medium"])
    details = F.concat(F.lit("indicators="), F.array_join("reasons", ","), F.coalesce(F.concat(F.lit("; scriptBlockSha256="), F.when(F.col("script_block_hash") != "", F.col("script_block_hash"))), F.lit("")))
    # Only flagged rows come here; their encoded text is decoded to be read, never run.
    shown = F.left(F.regexp_replace(decode_base64_preview(encoded_token()), r"[\r\n]+", " "), F.lit(PREVIEW))
    details = F.concat(details, F.coalesce(F.concat(F.lit("; preview="), F.when(shown != "", shown)), F.lit("")))
    return make_finding(d, "SuspiciousPowerShell", "Suspicious PowerShell activity", rank, "Script or command line with suspicious marks", details)


def encoded_token() -> Column:
    """The base64 token of a flagged ``blob``, for a preview."""
    named = F.regexp_extract("blob", ENCODED, 3)
    return F.when(named != "", named).otherwise(F.regexp_extract("blob", LONG_BASE64, 0))


def scheduled_tasks(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    d = events.where(F.col("event_id").isin(4698, 4702, 4699))
    # A missing property is '' and not null, so what would follow it is never reached.
    text = F.coalesce("command_line", prop("TaskContent"))
    d = d.withColumn("paths", once(suspicious_paths(text, s.task_paths)))
    action = F.when(F.col("event_id") == 4698, "created").when(F.col("event_id") == 4702, "updated").otherwise("deleted")
    rank = F.when(F.size("paths") > 0, RANK["High"]).otherwise(RANK["Medium"])
    description = F.concat(F.lit("Task '"), F.coalesce("task_name", F.lit("(unnamed)")), F.lit("' was "), action, F.when(F.size("paths") > 0, F.concat(F.lit("; paths: "), F.array_join("paths", ", "))).otherwise(""))
    return make_finding(d, "SuspiciousScheduledTask", F.concat(F.lit("Scheduled task "), action), rank, description, F.left(text, F.lit(800)))


def service_installs(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    image = F.coalesce("process_path", "command_line", F.lit("(unknown)"))
    return make_finding(events.where(F.col("event_id").isin(4697, 7045)), "ServiceInstallation", "Windows service installed", RANK["Medium"], F.concat(F.lit("Service '"), F.coalesce("service_name", F.lit("")), F.lit("' image: "), image))


def log_clearing(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    d = events.where((F.col("event_id") == 1102) | ((F.col("event_id") == 104) & provider_has("eventlog")))
    security = F.col("event_id") == 1102
    return make_finding(d, "LogClearing", F.when(security, "Security event log was cleared").otherwise("Windows event channel was cleared"), F.when(security, RANK["Critical"]).otherwise(RANK["High"]))


KERBEROS = "KerberosAndDirectoryAttack"


def ticket_account() -> Column:
    named = first_prop("TargetUserName", "TargetName", "AccountName")
    return F.when(named != "", named).otherwise(F.coalesce("target_user_name", "user_name", F.lit("")))


def ticket_source() -> Column:
    named = first_prop("IpAddress", "ClientAddress")
    return F.when(named != "", named).otherwise(F.coalesce("source_ip", F.lit("")))


def is_rc4() -> Column:
    return F.lower(prop("TicketEncryptionType")).isin("0x17", "23")


def is_kerberoast() -> Column:
    service = F.lower(prop("ServiceName"))
    return (F.col("event_id") == 4769) & is_rc4() & (service != "") & ~service.startswith("krbtgt") & ~service.endswith("$")


def directory_attacks(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Replication rights, roasting of accounts without pre-authentication, and lock-outs."""
    blob = F.lower(F.concat_ws("\n", "raw_xml", F.array_join(F.map_values("properties"), "\n")))
    sync = make_finding(events.where((F.col("event_id") == 4662) & contains_any(blob, REPLICATION_GUIDS)), KERBEROS, "Directory replication rights used (possible DCSync)", RANK["Critical"], details="signature=AD-001")
    roast = events.where((F.col("event_id") == 4768) & (first_prop("PreAuthType", "PreAuthenticationType") == "0") & is_rc4())
    out = sync.unionByName(make_finding(roast, KERBEROS, "AS-REP roasting indicator", RANK["High"], details=F.concat(F.lit("signature=AD-002; account="), ticket_account())))
    return out.unionByName(make_finding(events.where(F.col("event_id") == 4740), KERBEROS, "User account locked out", RANK["Medium"], details=F.concat(F.lit("signature=AD-005; account="), ticket_account())))


def largest_clusters(events: DataFrame, window_us: int, least: int) -> DataFrame:
    """The largest window of each (who, source), the earliest of equal ones: n, services and ends."""
    keys = ["who", "source"]
    d = events.withColumns({"who": F.lower(ticket_account()), "source": F.lower(ticket_source()), "us": micros(), "service": F.lower(prop("ServiceName"))})
    d = stored(window_ends(busy_runs(d.select(*keys, "us", "service", "row_id"), keys, window_us, least), keys, window_us), "window-events")
    size = F.col("end_rn") - F.col("rn") + 1
    best = d.withColumn("size", size).where(F.col("size") >= least).groupBy(*keys).agg(F.min(F.struct((-F.col("size")).alias("a"), "us", "row_id", "run", "bucket", "rn", "end_rn")).alias("b"))
    chosen = best.select(*keys, F.col("b.run").alias("run"), F.col("b.bucket").alias("bucket"), F.col("b.rn").alias("rn"), F.col("b.end_rn").alias("end_rn"))
    g = cluster_rows(d, chosen, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("service") != "", F.col("service"))).alias("services"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max_by("row_id", "rn").alias("p_row"), F.min_by("row_id", "rn").alias("first_row"),
    )
    return _with_primary(g, events, "p_row")


def kerberos_bursts(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    common = dict(related=F.array("first_row", "row_id"), count=F.col("n"), group_key=F.concat_ws("|", "who", "source"), first_us=F.col("first_us"), last_us=F.col("last_us"))
    pre = largest_clusters(events.where(F.col("event_id") == 4771), s.burst_window_us, max(3, s.burst_threshold))
    out = make_finding(pre, KERBEROS, PRE_AUTH_BURST, RANK["High"], details=F.concat(F.lit("signature=AD-003; count="), F.col("n").cast("string")), **common)
    roast = largest_clusters(events.where(is_kerberoast()), s.burst_window_us, 5).where(F.col("services") >= 3)
    return out.unionByName(make_finding(roast, KERBEROS, ROASTING_BURST, RANK["High"], details=F.concat(F.lit("signature=AD-004; tickets="), F.col("n").cast("string"), F.lit("; services="), F.col("services").cast("string")), **common))


def event_blob() -> Column:
    """The lower-cased text that signatures look into."""
    columns = ("process_name", "process_path", "parent_process_name", "command_line", "parent_command_line", "script_block", "service_name", "task_name", "query_name", "hashes", "raw_xml")
    bag = F.flatten(F.transform(F.map_entries("properties"), lambda e: F.array(e["key"], e["value"])))
    return F.lower(F.concat_ws("\n", *(F.when(~blank(F.col(c)), F.col(c)) for c in columns), bag))


def signature_predicate(sig: Signature) -> str:
    """The signature as SQL over the event's columns and ``blob``."""
    holds = lambda t: f"contains(blob, {sql_text(t.lower())})"
    parts = [declared_ids_sql(sig.event_ids)]
    if sig.provider:
        parts.append(f"coalesce(contains(lower(provider_name), {sql_text(sig.provider.lower())}), false)")
    if sig.processes:
        named = (f"coalesce(lower({c}) = {sql_text(n)} OR endswith(lower({c}), {sql_text(chr(92) + n)}), false)" for n in sig.processes for c in ("process_name", "process_path"))
        parts.append("(" + " OR ".join(named) + ")")
    if sig.any:
        parts.append("(" + " OR ".join(map(holds, sig.any)) + ")")
    parts += [*map(holds, sig.all), *(f"NOT {holds(t)}" for t in sig.exclude)]
    return " AND ".join(parts)


def signature_findings(events: DataFrame, catalogs: dict[str, tuple[Signature, ...]], batch: int = 64) -> DataFrame:
    """One finding for each event and signature: a pass without a shuffle for each ``batch`` of signatures.

    Events are cut down to the declared ids first, and the text is put together once. The rule is the
    signature's catalogue.
    """
    every = [(rule, s) for rule, signatures in catalogs.items() for s in signatures]
    out = None
    for k in range(0, len(every), batch):
        part = every[k : k + batch]
        ids = sorted({i for _, s in part for i in s.event_ids})
        d = events.where(F.col("event_id").isin(ids)) if all(s.event_ids for _, s in part) else events
        d = d.withColumn("blob", once(event_blob()))
        told = F.expr("array(" + ", ".join(f"named_struct('id', {sql_text(s.id)}, 'title', {sql_text(s.title)}, 'rank', {RANK[s.severity]}, 'rule', {sql_text(rule)})" for rule, s in part) + ")")
        hits = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {signature_predicate(s)} THEN {i} END" for i, (_, s) in enumerate(part)) + "))")
        d = d.withColumn("hits", once(hits)).withColumn("hit", F.explode("hits")).withColumn("sig", F.get(told, F.col("hit")))
        details = F.concat(F.lit("signature="), F.col("sig.id"), F.lit("; eventId="), F.col("event_id").cast("string"), F.lit("; process="), F.coalesce("process_name", F.lit("")), F.lit("; commandLine="), F.left(F.coalesce("command_line", F.lit("")), F.lit(500)))
        f = make_finding(d, "DefenseEvasion", F.col("sig.title"), F.col("sig.rank"), F.col("sig.title"), details, rule_id=F.col("sig.id"), named=F.col("sig.rule"))
        out = f if out is None else out.unionByName(f)
    return out


def signatures(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    return signature_findings(events, s.signatures)


def dns_tunnelling(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    query = F.coalesce("query_name", prop("QueryName"))
    labels = F.filter(F.split(F.rtrim(query, F.lit(".")), r"\."), lambda x: x.rlike(r"(?i)^[a-z0-9+/=_-]{45,}$") & (F.size(F.array_distinct(F.filter(F.split(x, ""), lambda ch: ch != ""))) >= 12))
    d = events.where((F.col("event_id") == 22) & is_sysmon()).withColumn("query", query).where(~blank(F.col("query"))).withColumn("label", once(F.get(labels, F.lit(0))))
    length = F.char_length("query")
    d = d.where((length >= 180) | F.col("label").isNotNull())
    details = F.concat(F.lit("signature=MB-017; query="), F.col("query"), F.lit("; length="), length.cast("string"), F.lit("; encodedLabelLength="), F.coalesce(F.char_length("label"), F.lit(0)).cast("string"))
    return make_finding(d, "MalwareBehavior", "Possible DNS tunneling or encoded exfiltration", F.when(length >= 220, RANK["High"]).otherwise(RANK["Medium"]), details=details)


#: Detectors by name; users add their own callables of (events, settings).
STATELESS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "process_creation": process_creation, "powershell": suspicious_powershell, "scheduled_task": scheduled_tasks, "service_install": service_installs,
    "log_clearing": log_clearing, "privilege_change": privilege_changes, "directory_attack": directory_attacks, "dns_tunnelling": dns_tunnelling,
    "signatures": signatures,
}
GROUPED: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "failed_logon": failed_logons, "successful_logon": successful_logons, "rdp": rdp_activity, "brute_force": brute_force, "password_spray": password_spray,
    "new_user": new_users, "kerberos_burst": kerberos_bursts,
}
DETECTORS = STATELESS | GROUPED
