"""The event table: one fixed row type and an open property map with lower-case keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_DDL = (
    "row_id bigint, computer_name string, log_name string, provider_name string, event_id int, event_record_id bigint, "
    "time_created_utc timestamp, level string, user_name string, domain string, process_name string, process_id int, "
    "parent_process_name string, parent_process_id int, command_line string, source_ip string, destination_ip string, "
    "workstation_name string, target_user_name string, target_domain_name string, raw_xml string, properties map<string,string>, "
    "script_block string, script_block_hash string, hashes string, process_guid string, parent_process_guid string, "
    "parent_command_line string, source_port int, destination_port int, query_name string, task_name string, service_name string, "
    "logon_type int, process_path string"
)
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}
EVENT_SCHEMA = T.StructType([T.StructField(*(lambda name, kind: (name, _TYPES[kind]))(*c.split(" "))) for c in EVENT_DDL.split(", ")])
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA]

# Severities in order.
SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")
RANK = {s: i for i, s in enumerate(SEVERITIES)}


def as_events(df: DataFrame) -> DataFrame:
    """Casts to the event type; columns that ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def micros(column: str | Column = "time_created_utc") -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def prop(name: str, blank: bool = True) -> Column:
    """A property by name, whatever its case; missing or blank gives '' (or null)."""
    value = F.try_element_at("properties", F.lit(name.lower()))
    value = F.when(F.trim(value) != "", value)
    return F.coalesce(value, F.lit("")) if blank else value


def first_prop(*names: str) -> Column:
    """The first of some properties that is not blank, else ''."""
    return F.coalesce(*(prop(n, blank=False) for n in names), F.lit(""))


def is_sysmon() -> Column:
    return F.coalesce(F.lower("provider_name").contains("sysmon"), F.lit(False))


def once(c: Column) -> Column:
    """The same value, but marked as not deterministic: predicates on it are not pushed below the
    projection that makes it, which would write the whole expression out in each of them."""
    return F.when(F.spark_partition_id() >= 0, c)
