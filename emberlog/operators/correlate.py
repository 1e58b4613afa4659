"""Chains of events: an anchor and the first fitting successors within a window.

Anchors and successors are sorted together by key and time bucket, so pairs are never joined. Texts are held
against names by an index of their grams; events then meet by the name that was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, contains_ci
from ..schema import RANK, is_sysmon, micros, prop, severity_name
from ..storage import stored
from .containment import containing
from .detectors import MINUTE, is_process_start
from .windows import busy_runs, cluster_rows, first_after, window_ends

# Programs that remote logons should not start.
REMOTE_PROGRAMS = ("cmd.exe", "powershell.exe", "pwsh.exe", "wmic.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "psexec.exe")


def account_ip() -> Column:
    return F.concat(F.lower(F.coalesce("target_user_name", "user_name", F.lit(""))), F.lit("|"), F.lower(F.coalesce("source_ip", F.lit(""))))


def _side(df: DataFrame, prefix: str, **columns: Column) -> DataFrame:
    made = {"us": micros(), "row": F.col("row_id"), **columns}
    return df.select(*(c.alias(f"{prefix}_{n}") for n, c in made.items()))


def _chain(df: DataFrame, scenario: str, title: str, severity: str, time_us: Column, user: Column, host: Column, ip: Column | None, details: Column, related: Column) -> DataFrame:
    return df.select(
        F.lit(scenario).alias("scenario"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(RANK[severity]).alias("severity_rank"),
        F.timestamp_micros(time_us).alias("time_utc"), user.alias("user_name"), host.alias("computer_name"),
        (ip if ip is not None else F.lit(None).cast("string")).alias("source_ip"), details.alias("details"),
        F.filter(related, lambda i: i > 0).alias("related_event_row_ids"),
    )


def _compromised(events: DataFrame, window_us: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(Ranked failures, one chain for each account and address).

    For each start of a large enough window the first logon after its last failure is taken; if no
    privileges follow that logon, the next start is tried.
    """
    fails = events.where(F.col("event_id") == 4625).select(account_ip().alias("key"), micros().alias("us"), "row_id")
    d = stored(window_ends(busy_runs(fails, ["key"], window_us, least), ["key"], window_us), "window-events")
    starts = d.where(F.col("end_rn") - F.col("rn") + 1 >= least)
    last = d.select("key", "run", F.col("rn").alias("end_rn"), F.col("us").alias("last_us"))
    starts = starts.join(last, ["key", "run", "end_rn"]).select(F.col("row_id").alias("start_row"), "key", "run", "bucket", "rn", "end_rn", F.col("us").alias("start_us"), "last_us")
    wins = _side(events.where(F.col("event_id") == 4624), "s", key=account_ip(), user=F.coalesce("target_user_name", "user_name"), host=F.col("computer_name"), ip=F.col("source_ip"))
    hit = first_after(starts, wins, "start_row", [("key", "s_key")], F.col("last_us"), F.col("last_us") + window_us, "s_us", "s_row", window_us, keep=["s_user", "s_host", "s_ip"])
    d2 = starts.join(hit, "start_row").withColumn("who", F.lower("hit.s_user")).withColumn("won_us", F.col("hit.us")).withColumnRenamed("hit", "won")
    special = _side(events.where(F.col("event_id") == 4672), "p", user=F.lower("user_name"))
    hit2 = first_after(d2, special, "start_row", [("who", "p_user")], F.col("won_us"), F.col("won_us") + window_us, "p_us", "p_row", window_us)
    full = d2.join(hit2, "start_row")
    # Of each account and address the earliest start.
    return d, full.groupBy("key").agg(F.min_by(F.struct("start_row", "run", "bucket", "rn", "end_rn", "won", "hit"), F.struct("start_us", "rn")).alias("c")).select("key", "c.*")


def compromised_account(events: DataFrame, window_us: int = 10 * MINUTE, least: int = 5) -> DataFrame:
    """Failures, then a logon, then special privileges; ``compromised_account_events`` has all failures."""
    _, first = _compromised(events, window_us, least)
    return _chain(
        first, "FailedLogonsThenPrivilegedSuccess", "Potential compromised privileged account", "Critical", F.col("hit.us"), F.col("won.s_user"), F.col("won.s_host"), F.col("won.s_ip"),
        F.concat(F.lit("failures="), (F.col("end_rn") - F.col("rn") + 1).cast("string"), F.lit("; account="), F.col("key")), F.array(F.col("start_row"), F.col("won.id"), F.col("hit.id")),
    )


def compromised_account_events(events: DataFrame, window_us: int = 10 * MINUTE, least: int = 5) -> DataFrame:
    """(scenario, key, row_id): every failure of each chain's window, the logon and the privileges."""
    d, first = _compromised(events, window_us, least)
    fails = cluster_rows(d, first, ["key"]).select("key", "row_id")
    rest = first.select("key", F.explode(F.array("won.id", "hit.id")).alias("row_id"))
    return fails.unionByName(rest).select(F.lit("FailedLogonsThenPrivilegedSuccess").alias("scenario"), "key", "row_id")


def suspicious_account(events: DataFrame, window_us: int = 10 * MINUTE) -> DataFrame:
    """A new account, put into a group, then used."""
    created = events.where((F.col("event_id") == 4720) & (F.coalesce("target_user_name", F.lit("")) != ""))
    c = _side(created, "c", name=F.col("target_user_name"), host=F.col("computer_name"), creator=F.col("user_name"))
    g = _side(events.where(F.col("event_id").isin(4728, 4732)), "g", target=F.col("target_user_name"), raw=F.col("raw_xml"), member=prop("MemberName"))
    c = c.withColumn("c_low", F.lower("c_name"))
    g = stored(g.withColumn("g_text", F.concat_ws("\0", "g_target", "g_raw", "g_member")), "chain-groups")
    named = containing(g, "g_row", "g_text", c.select(F.col("c_low").alias("pattern"))).withColumnsRenamed({"g_row": "of_row", "pattern": "g_name"})
    added = first_after(c, g.join(named, F.col("g_row") == F.col("of_row")), "c_row", [("c_low", "g_name")], F.col("c_us"), F.col("c_us") + window_us, "g_us", "g_row", window_us)
    d = c.join(added, "c_row").withColumnRenamed("hit", "added").withColumn("a_us", F.col("added.us"))
    logons = _side(events.where(F.col("event_id") == 4624), "l", name=F.lower("target_user_name"))
    used = first_after(d, logons, "c_row", [("c_low", "l_name")], F.col("a_us"), F.col("a_us") + window_us, "l_us", "l_row", window_us)
    d = d.join(used, "c_row")
    return _chain(
        d, "AccountCreatedThenPrivilegedThenLogon", "Potential suspicious account creation and privilege assignment", "High", F.col("hit.us"), F.col("c_name"), F.col("c_host"), None,
        F.concat(F.lit("newUser="), F.col("c_name")), F.array(F.col("c_row"), F.col("added.id"), F.col("hit.id")),
    )


def _processes(events: DataFrame) -> DataFrame:
    return _side(
        events.where(is_process_start()), "p", path=F.col("process_path"), name=F.col("process_name"), command=F.col("command_line"), host=F.lower("computer_name"),
        user=F.coalesce("target_user_name", "user_name"),
    )


def _held(anchors: DataFrame, anchor_id: str, text: str, processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Anchors once for each process path or name that their text contains, processes by path and by name), both with ``held``."""
    names = F.array_distinct(F.array(F.lower(F.coalesce("p_path", F.lit(""))), F.lower(F.coalesce("p_name", F.lit("")))))
    by_name = processes.withColumn("p_held", F.explode(names)).where("p_held <> ''")
    pairs = containing(anchors, anchor_id, text, by_name.select(F.col("p_held").alias("pattern"))).withColumnsRenamed({anchor_id: "of_row", "pattern": "held"})
    return anchors.join(pairs, F.col(anchor_id) == F.col("of_row")), by_name


def task_persistence(events: DataFrame, window_us: int = 10 * MINUTE) -> DataFrame:
    """A task, then a process that its text names by path or file name, or whose command names the task."""
    t = _side(events.where(F.col("event_id") == 4698), "t", text=F.coalesce("command_line", "raw_xml", F.lit("")), name=F.col("task_name"), user=F.col("user_name"), host=F.col("computer_name"))
    t = stored(t.withColumn("t_low", F.lower("t_name")), "chain-tasks")
    args = (F.col("t_us"), F.col("t_us") + window_us, "p_us", "p_row", window_us, ["p_name", "p_path"])
    processes = stored(_processes(events), "chain-processes")
    asks, by_name = _held(t, "t_row", "t_text", processes)
    by_text = first_after(asks, by_name, "t_row", [("held", "p_held")], *args)
    # Commands are looked through only where a task lies within the window before them.
    near = t.select(F.explode(F.array(*(F.floor(F.col("t_us") / window_us) + k for k in (0, 1)))).alias("slot")).distinct()
    late = stored(processes.withColumn("slot", F.floor(F.col("p_us") / window_us)).join(near, "slot", "left_semi").drop("slot"), "chain-commands")
    told = containing(late, "p_row", "p_command", t.select(F.col("t_low").alias("pattern"))).withColumnsRenamed({"p_row": "of_row", "pattern": "p_task"})
    by_command = first_after(t, late.join(told, F.col("p_row") == F.col("of_row")), "t_row", [("t_low", "p_task")], *args)
    hit = by_text.unionByName(by_command).groupBy("t_row").agg(F.min("hit").alias("hit"))
    d = t.join(hit, "t_row")
    details = F.concat(F.lit("task="), F.coalesce("t_name", F.lit("")), F.lit("; process="), F.coalesce("hit.p_name", F.lit("")))
    return _chain(d, "ScheduledTaskThenProcess", "Potential persistence mechanism", "High", F.col("hit.us"), F.col("t_user"), F.col("t_host"), None, details, F.array(F.col("t_row"), F.col("hit.id")))


def script_to_network(events: DataFrame, window_us: int = 10 * MINUTE) -> DataFrame:
    """A script block, then a shell process on the host, then a connection of that process."""
    s = _side(events.where(F.col("event_id") == 4104), "s", host=F.lower("computer_name"), user=F.col("user_name"))
    shell = contains_ci(F.col("process_name"), "powershell") | contains_ci(F.col("process_path"), "powershell")
    extra = dict(host=F.lower("computer_name"), shown=F.col("computer_name"), user=F.col("user_name"), guid=F.lower("process_guid"), pid=F.col("process_id"), name=F.lower("process_name"))
    p = _side(events.where((F.col("event_id") == 1) & is_sysmon() & shell), "p", **extra)
    keep = [f"p_{k}" for k in extra]
    hit = first_after(s, p, "s_row", [], F.col("s_us") - MINUTE, F.col("s_us") + window_us, "p_us", "p_row", window_us, keep, [("s_host", "p_host")])
    d = s.join(hit, "s_row").select("s_row", "s_user", F.col("hit.us").alias("q_us"), F.col("hit.id").alias("q_row"), *(F.col(f"hit.{k}").alias("q" + k[1:]) for k in keep))
    n = _side(events.where((F.col("event_id") == 3) & is_sysmon()), "n", host=F.lower("computer_name"), guid=F.lower("process_guid"), pid=F.col("process_id"), name=F.lower("process_name"), to=F.col("destination_ip"), ip=F.col("source_ip"), port=F.col("destination_port"))
    low, high, more = F.col("q_us"), F.col("q_us") + window_us, ["n_to", "n_ip", "n_port"]
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    # The same process by guid, or by number, or by name on the host.
    by_guid = first_after(d.where(known("q_guid")), n.where(known("n_guid")), "s_row", [("q_guid", "n_guid")], low, high, "n_us", "n_row", window_us, more)
    by_pid, by_name = (first_after(d.where(known(f"q_{k}")), n, "s_row", [(f"q_{k}", f"n_{k}")], low, high, "n_us", "n_row", window_us, more, [("q_host", "n_host")]) for k in ("pid", "name"))
    hit2 = by_guid.unionByName(by_pid).unionByName(by_name).groupBy("s_row").agg(F.min("hit").alias("hit"))
    d = d.join(hit2, "s_row")
    details = F.concat(F.lit("pid="), F.coalesce(F.col("q_pid").cast("string"), F.lit("")), F.lit("; dest="), F.coalesce("hit.n_to", F.lit("")))
    return _chain(
        d, "PowerShellThenProcessThenNetwork", "PowerShell activity followed by process creation and network connection", "High", F.col("hit.us"), F.coalesce("q_user", "s_user"), F.col("q_shown"),
        F.coalesce("hit.n_to", "hit.n_ip"), details, F.array(F.col("s_row"), F.col("q_row"), F.col("hit.id")),
    )


def remote_logon_to_process(events: DataFrame, window_us: int = 10 * MINUTE) -> DataFrame:
    far = (F.col("event_id") == 4624) & F.col("logon_type").isin(3, 8, 9, 10) & ~blank(F.col("source_ip")) & (F.col("source_ip") != "-")
    a = _side(events.where(far), "a", host=F.lower("computer_name"), shown=F.col("computer_name"), user=F.coalesce("target_user_name", "user_name"), ip=F.col("source_ip"), type=F.col("logon_type"))
    p = _processes(events).where(F.lower("p_name").isin(*REMOTE_PROGRAMS))
    account = lambda c: F.when(~blank(F.col(c)), F.lower(c))
    a, p = a.withColumn("a_low", account("a_user")), p.withColumn("p_low", account("p_user"))
    hit = first_after(a, p, "a_row", [], F.col("a_us"), F.col("a_us") + window_us, "p_us", "p_row", window_us, ["p_name", "p_command"], [("a_host", "p_host"), ("a_low", "p_low")])
    d = a.join(hit, "a_row")
    details = F.concat(F.lit("logonType="), F.col("a_type").cast("string"), F.lit("; process="), F.col("hit.p_name"))
    return _chain(d, "RemoteLogonThenSuspiciousProcess", "Remote authentication followed by suspicious process execution", "High", F.col("hit.us"), F.col("a_user"), F.col("a_shown"), F.col("a_ip"), details, F.array(F.col("a_row"), F.col("hit.id")))


def service_to_process(events: DataFrame, window_us: int = 10 * MINUTE) -> DataFrame:
    v = _side(events.where(F.col("event_id").isin(4697, 7045)), "v", image=F.coalesce("process_path", "command_line", F.lit("")), host=F.lower("computer_name"), shown=F.col("computer_name"), user=F.col("user_name"), name=F.col("service_name"))
    v = stored(v, "chain-services")
    asks, by_name = _held(v, "v_row", "v_image", stored(_processes(events), "chain-processes"))
    by_name = by_name.where(~blank(F.col("p_held")))
    hit = first_after(asks, by_name, "v_row", [("held", "p_held")], F.col("v_us"), F.col("v_us") + window_us, "p_us", "p_row", window_us, ["p_name"], [("v_host", "p_host")])
    d = v.join(hit, "v_row")
    details = F.concat(F.lit("service="), F.coalesce("v_name", F.lit("")), F.lit("; image="), F.col("v_image"), F.lit("; process="), F.coalesce("hit.p_name", F.lit("")))
    return _chain(d, "ServiceInstalledThenProcess", "New service followed by matching process execution", "High", F.col("hit.us"), F.col("v_user"), F.col("v_shown"), None, details, F.array(F.col("v_row"), F.col("hit.id")))


CHAINS = {
    "compromised_account": compromised_account, "suspicious_account": suspicious_account, "task_persistence": task_persistence, "script_to_network": script_to_network,
    "remote_logon": remote_logon_to_process, "service_process": service_to_process,
}


def all_chains(events: DataFrame, window_us: int = 10 * MINUTE) -> DataFrame:
    out = None
    for f in CHAINS.values():
        part = f(events, window_us)
        out = part if out is None else out.unionByName(part)
    return out
