"""Fixed code tables of the standards, as dimension rows and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stream types of ISO/IEC 13818-1 and ATSC/SCTE (code, name, kind), and the descriptions that labels are made of.
STREAM_TYPES = [
    (0x01, "MPEG1_VIDEO", "VIDEO", "MPEG-1 Video"), (0x02, "MPEG2_VIDEO", "VIDEO", "MPEG-2 Video"), (0x03, "MPEG1_AUDIO", "AUDIO", "MPEG-1 Audio"), (0x04, "MPEG2_AUDIO", "AUDIO", "MPEG-2 Audio"),
    (0x05, "PRIVATE_SECTIONS", "DATA", "Private sections"), (0x06, "PRIVATE_PES", "DATA", "Private PES"), (0x0F, "ADTS_AAC", "AUDIO", "AAC (ADTS)"), (0x10, "MPEG4_VIDEO", "VIDEO", "MPEG-4 Video"), (0x11, "LATM_AAC", "AUDIO", "AAC (LATM)"),
    (0x1B, "H264", "VIDEO", "H.264 / AVC"), (0x1C, "MPEG4_AUDIO", "AUDIO", "MPEG-4 Audio"), (0x24, "HEVC", "VIDEO", "H.265 / HEVC"), (0x33, "VVC", "VIDEO", "H.266 / VVC"),
    (0x81, "AC3", "AUDIO", "AC-3"), (0x86, "SCTE35", "DATA", "SCTE-35 splice"), (0x87, "EAC3", "AUDIO", "E-AC-3"),
]
# Running status of EN 300 468 by code; 6 and 7 are reserved.
RUNNING_STATUS = ["UNDEFINED", "NOT_RUNNING", "STARTS_IN_A_FEW_SECONDS", "PAUSING", "RUNNING", "SERVICE_OFF_AIR", "RESERVED", "RESERVED"]
# Segmentation types of SCTE 35 (code, label).
SEGMENTATION_TYPES = [
    (0x00, "Not Indicated"), (0x01, "Content Identification"), (0x10, "Program Start"), (0x11, "Program End"), (0x12, "Program Early Termination"), (0x13, "Program Breakaway"), (0x14, "Program Resumption"), (0x15, "Program Runover Planned"),
    (0x16, "Program Runover Unplanned"), (0x17, "Program Overlap Start"), (0x18, "Program Blackout Override"), (0x19, "Program Join"), (0x20, "Chapter Start"), (0x21, "Chapter End"), (0x22, "Break Start"), (0x23, "Break End"),
    (0x24, "Opening Credit Start"), (0x25, "Opening Credit End"), (0x26, "Closing Credit Start"), (0x27, "Closing Credit End"), (0x30, "Provider Advertisement Start"), (0x31, "Provider Advertisement End"),
    (0x32, "Distributor Advertisement Start"), (0x33, "Distributor Advertisement End"), (0x34, "Provider Placement Opportunity Start"), (0x35, "Provider Placement Opportunity End"),
    (0x36, "Distributor Placement Opportunity Start"), (0x37, "Distributor Placement Opportunity End"), (0x38, "Provider Overlay Placement Opportunity Start"), (0x39, "Provider Overlay Placement Opportunity End"),
    (0x3A, "Distributor Overlay Placement Opportunity Start"), (0x3B, "Distributor Overlay Placement Opportunity End"), (0x40, "Unscheduled Event Start"), (0x41, "Unscheduled Event End"),
    (0x42, "Alternate Content Opportunity Start"), (0x43, "Alternate Content Opportunity End"), (0x50, "Network Start"), (0x51, "Network End"),
]
# Splice commands of SCTE 35 (code, label).
SPLICE_COMMANDS = [(0x00, "splice_null"), (0x04, "splice_schedule"), (0x05, "splice_insert"), (0x06, "time_signal"), (0x07, "bandwidth_reservation"), (0xFF, "private_command")]

KIND = {code: kind for code, _, kind, _ in STREAM_TYPES}
DESCRIPTION = {code: text for code, _, _, text in STREAM_TYPES}
SEGMENTATION = dict(SEGMENTATION_TYPES)
COMMAND = dict(SPLICE_COMMANDS)


def stream_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STREAM_TYPES, "code int, name string, kind string, description string")


def segmentation_types(spark: SparkSession) -> DataFrame:
    rows = [(c, label, c > 1 and c % 2 == 0, 0x34 <= c <= 0x3B) for c, label in SEGMENTATION_TYPES]
    return spark.createDataFrame(rows, "code int, label string, is_start boolean, is_placement_opportunity boolean")


def splice_commands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, label, c in (5, 6)) for c, label in SPLICE_COMMANDS], "code int, label string, is_parsed boolean")


def _lookup(code: Column, found: dict[int, str], default: Column) -> Column:
    out = None
    for key, value in found.items():
        out = F.when(code == key, value) if out is None else out.when(code == key, value)
    return out.otherwise(default)


def stream_kind(code: Column) -> Column:
    return _lookup(code, KIND, F.lit("UNKNOWN"))


def stream_label(code: Column) -> Column:
    return _lookup(code, DESCRIPTION, F.concat(F.lit("type 0x"), F.hex(code)))


def running_status(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, RUNNING_STATUS)), code), F.lit("RESERVED"))


def segmentation_label(code: Column) -> Column:
    return _lookup(code, SEGMENTATION, F.lit("Unknown"))


def command_label(code: Column) -> Column:
    return _lookup(code, COMMAND, F.lit("unknown"))


def is_segmentation_start(code: Column) -> Column:
    return (code > 1) & (code % 2 == 0)


def is_placement_opportunity(code: Column) -> Column:
    return code.between(0x34, 0x3B)
