"""The drainage model as text: section tables, rows, document, rain files and result series.

A section is a DataFrame; each row becomes one line by column expressions
alone.  A document is the union of its sections' lines with their sort keys;
only writing it sorts globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import flag, general, hours_minutes

# Sections in the order in which a model lists them.
ORDER = (
    "TITLE", "OPTIONS", "EVAPORATION", "REPORT", "RAINGAGES", "SUBCATCHMENTS", "SUBAREAS", "INFILTRATION", "JUNCTIONS", "OUTFALLS", "STORAGE", "CONDUITS", "PUMPS",
    "ORIFICES", "WEIRS", "OUTLETS", "XSECTIONS", "LOSSES", "INFLOWS", "DWF", "CURVES", "TIMESERIES", "PATTERNS", "POLLUTANTS", "LANDUSES", "COVERAGES", "LOADINGS",
    "BUILDUP", "WASHOFF", "AQUIFERS", "GROUNDWATER", "CONTROLS", "TAGS", "MAP", "COORDINATES", "VERTICES", "Polygons",
)
#: These are written even when empty.
ALWAYS = ("TITLE", "OPTIONS", "EVAPORATION", "REPORT")

# A section's columns as (name, width, default); an empty default stays empty.
COLUMNS = {
    "JUNCTIONS": (("Name", 16, ""), ("InvertElev", 12, "0"), ("MaxDepth", 12, "0"), ("InitDepth", 12, "0"), ("SurchargeDepth", 16, "0"), ("PondedArea", 12, "0")),
    "OUTFALLS": (("Name", 16, ""), ("InvertElev", 10, "0"), ("OutfallType", 10, "FREE"), ("StageOrTimeseries", 16, ""), ("TideGate", 8, "NO"), ("RouteTo", 16, "")),
    "STORAGE": (("Name", 16, ""), ("InvertElev", 8, "0"), ("MaxDepth", 10, "10"), ("InitDepth", 10, "0"), ("StorageCurve", 10, "FUNCTIONAL"), ("Coefficient", 8, "1000"), ("Exponent", 8, "0"), ("Constant", 8, "0"), ("SurDepth", 8, "0"), ("EvapFrac", 8, "0"), ("Psi", 8, ""), ("Ksat", 8, ""), ("IMD", 8, "")),
    "CONDUITS": (("Name", 16, ""), ("InletNode", 16, ""), ("OutletNode", 16, ""), ("Length", 10, "0"), ("Roughness", 10, "0.01"), ("InOffset", 10, "0.0001"), ("OutOffset", 10, "0.0001"), ("InitFlow", 10, "0"), ("MaxFlow", 10, "1e+10")),
    "PUMPS": (("Name", 16, ""), ("InletNode", 16, ""), ("OutletNode", 16, ""), ("PumpCurve", 16, ""), ("InitStatus", 8, "ON"), ("Depth", 8, "0"), ("ShutoffDepth", 12, "0")),
    "ORIFICES": (("Name", 16, ""), ("InletNode", 16, ""), ("OutletNode", 16, ""), ("OrificeType", 12, "SIDE"), ("CrestHeight", 10, "0"), ("DischCoeff", 10, "0.65"), ("FlapGate", 8, "YES"), ("OpenCloseTime", 12, "0")),
    "WEIRS": (("Name", 16, ""), ("InletNode", 16, ""), ("OutletNode", 16, ""), ("WeirType", 12, "TRANSVERSE"), ("CrestHeight", 10, "0"), ("DischCoeff", 10, "1.84"), ("FlapGate", 8, "YES"), ("EndCon", 8, "0"), ("EndCoeff", 10, "0"), ("Surcharge", 10, "YES")),
    "OUTLETS": (("Name", 16, ""), ("InletNode", 16, ""), ("OutletNode", 16, ""), ("OutflowHeight", 10, "0"), ("OutletType", 20, "FUNCTIONAL/DEPTH"), ("Qcoeff", 10, "0"), ("Qexpon", 8, "1"), ("FlapGate", 8, "NO")),
    "XSECTIONS": (("Link", 16, ""), ("Shape", 12, "CIRCULAR"), ("Geom1", 16, "0"), ("Geom2", 10, "0"), ("Geom3", 10, "0"), ("Geom4", 10, "0"), ("Barrels", 10, "1"), ("Culvert", 10, "")),
    "LOSSES": (("Link", 16, ""), ("Inlet", 10, "0"), ("Outlet", 10, "0"), ("Average", 10, "0"), ("FlapGate", 10, "NO"), ("SeepageRate", 12, "0")),
    "SUBCATCHMENTS": (("Name", 16, ""), ("Raingage", 16, ""), ("Outlet", 16, ""), ("Area", 8, "0"), ("PercImperv", 8, "0"), ("Width", 8, "0"), ("PercSlope", 8, "0"), ("CurbLength", 8, "0"), ("SnowPack", 16, "")),
    "SUBAREAS": (("Name", 16, ""), ("N-Imperv", 10, "0.015"), ("N-Perv", 10, "0.15"), ("S-Imperv", 10, "0.05"), ("S-Perv", 10, "0.1"), ("PctZero", 10, "25"), ("RouteTo", 10, "OUTLET"), ("PctRouted", 10, "")),
    "INFILTRATION": (("Subcatchment", 16, ""), ("MaxRate", 10, "3"), ("MinRate", 10, "0.5"), ("Decay", 10, "4"), ("DryTime", 10, "7"), ("MaxInfil", 10, "0")),
    "INFILTRATION/GREEN_AMPT": (("Subcatchment", 16, ""), ("Suction", 10, "3.5"), ("HydCon", 10, "0.5"), ("IMDmax", 10, "0.25")),
    "INFILTRATION/CURVE_NUMBER": (("Subcatchment", 16, ""), ("CurveNum", 10, "75"), ("HydCon", 10, "0.5"), ("DryTime", 10, "7")),
    "RAINGAGES": (("Name", 16, ""), ("Format", 9, "VOLUME"), ("Interval", 8, "1:00"), ("SCF", 8, "1"), ("Source", 10, "FILE"), ("Filename", 20, ""), ("Station", 16, ""), ("Units", 8, "IN")),
    "INFLOWS": (("Node", 16, ""), ("Constituent", 16, "FLOW"), ("TimeSeries", 16, '""'), ("Type", 8, "FLOW"), ("Mfactor", 8, "1"), ("Sfactor", 8, "1"), ("Baseline", 8, "0"), ("Pattern", 16, "")),
    "POLLUTANTS": (("Name", 16, ""), ("MassUnits", 8, "MG/L"), ("RainConcen", 10, "0"), ("GWConcen", 10, "0"), ("IIConcen", 10, "0"), ("DecayCoeff", 10, "0"), ("SnowOnly", 8, "NO"), ("CoPollutant", 12, "*"), ("CoFraction", 10, "0"), ("DWFConcen", 10, "0"), ("InitConcen", 10, "0")),
    "LANDUSES": (("Name", 16, ""), ("CleaningInterval", 16, "0"), ("FractionAvailable", 16, "0"), ("LastCleaned", 12, "0")),
    "BUILDUP": (("LandUse", 16, ""), ("Pollutant", 16, ""), ("Function", 10, "NONE"), ("Coeff1", 10, "0"), ("Coeff2", 10, "0"), ("Coeff3", 10, "0"), ("Normalizer", 10, "AREA")),
    "WASHOFF": (("LandUse", 16, ""), ("Pollutant", 16, ""), ("Function", 10, "NONE"), ("Coeff1", 10, "0"), ("Coeff2", 10, "0"), ("CleaningEffic", 12, "0"), ("BMPEffic", 10, "0")),
    "AQUIFERS": (("Name", 16, ""), ("Por", 8, "0.5"), ("WP", 8, "0.15"), ("FC", 8, "0.3"), ("Ksat", 8, "0.1"), ("Kslope", 8, "5"), ("Tslope", 8, "15"), ("ETu", 8, "0.35"), ("ETs", 8, "14"), ("Seep", 8, "0.002"), ("Ebot", 8, "0"), ("Egw", 8, "10"), ("Umc", 8, "0.3"), ("ETupat", 12, "")),
    "GROUNDWATER": (("Subcatchment", 16, ""), ("Aquifer", 16, ""), ("Node", 16, ""), ("Esurf", 8, "0"), ("A1", 8, "0"), ("B1", 8, "0"), ("A2", 8, "0"), ("B2", 8, "0"), ("A3", 8, "0"), ("Dsw", 8, "0"), ("Egwt", 8, ""), ("Ebot", 8, ""), ("Wgr", 8, ""), ("Umc", 8, "")),
    "COORDINATES": (("Name", 16, ""), ("X", 18, "0"), ("Y", 18, "0")),
    "VERTICES": (("Link", 16, ""), ("X", 18, ""), ("Y", 18, "")),
    "Polygons": (("Subcatchment", 16, ""), ("X", 18, ""), ("Y", 18, "")),
    "DWF": (("Node", 16, ""), ("Constituent", 16, "FLOW"), ("Baseline", 10, "0"), ("Patterns", 30, "")),
    "CURVES": (("Name", 16, ""), ("Type", 10, ""), ("X", 12, ""), ("Y", 12, "")),
    "TIMESERIES": (("Name", 16, ""), ("Date", 10, ""), ("Time", 10, ""), ("Value", 10, "")),
    "PATTERNS": (("Name", 16, ""), ("Type", 10, ""), ("Multipliers", 60, "")),
    "TAGS": (("Object", 10, ""), ("Name", 16, ""), ("Tag", 16, "")),
    "CONTROLS": (("Rule", 80, ""),),
    "COVERAGES": (("Subcatchment", 16, ""), ("LandUse", 16, ""), ("Percent", 10, "")),
    "LOADINGS": (("Subcatchment", 16, ""), ("Pollutant", 16, ""), ("InitBuildup", 10, "")),
    "MAP": (("Key", 12, ""), ("Value", 60, "")),
    "TITLE": (("Text", 80, ""),),
    "OPTIONS": (("Option", 20, ""), ("Value", 20, "")),
    "EVAPORATION": (("Type", 16, ""), ("Value", 16, "")),
    "REPORT": (("Item", 16, ""), ("Value", 16, "")),
}
# Run options and their defaults; empty ones aren't written.
OPTIONS = {
    "FLOW_UNITS": "LPS",
    "INFILTRATION": "HORTON",
    "FLOW_ROUTING": "DYNWAVE",
    "LINK_OFFSETS": "DEPTH",
    "MIN_SLOPE": "0.001",
    "ALLOW_PONDING": "NO",
    "SKIP_STEADY_STATE": "NO",
    "START_DATE": "",
    "START_TIME": "",
    "REPORT_START_DATE": "",
    "REPORT_START_TIME": "",
    "END_DATE": "",
    "END_TIME": "",
    "SWEEP_START": "01/01",
    "SWEEP_END": "12/31",
    "DRY_DAYS": "0",
    "REPORT_STEP": "00:15:00",
    "WET_STEP": "00:05:00",
    "DRY_STEP": "01:00:00",
    "ROUTING_STEP": "00:00:05",
    "RULE_STEP": "00:00:00",
    "INERTIAL_DAMPING": "PARTIAL",
    "NORMAL_FLOW_LIMITED": "BOTH",
    "FORCE_MAIN_EQUATION": "H-W",
    "VARIABLE_STEP": "0.75",
    "LENGTHENING_STEP": "0",
    "MIN_SURFAREA": "1.167",
    "MAX_TRIALS": "20",
    "HEAD_TOLERANCE": "0",
    "SYS_FLOW_TOL": "5",
    "LAT_FLOW_TOL": "5",
    "MINIMUM_STEP": "0.5",
    "THREADS": "1",
    "SURCHARGE_METHOD": "SLOT",
}


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and i and not name[i - 1].isupper() else c.lower() for i, c in enumerate(name)).replace("-_", "_").replace("-", "_")


def _text(df: DataFrame, name: str, default: str) -> Column:
    """A column of a section as text: by its name, else in snake case, else the default; nulls take the default."""
    found = next((c for c in (name, snake(name)) if c in df.columns), None)
    if found is None:
        return F.lit(default)
    kind = df.schema[found].dataType.typeName()
    c = F.col(f"`{found}`")
    shown = flag(c) if kind == "boolean" else general(c.cast("double")) if kind in ("double", "float", "decimal") else c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), shown), F.lit(default))


def rows(section: str, df: DataFrame, order: str, kind: str | None = None) -> DataFrame:
    """(section_no, ord, text): one line per row, sorted later by `order`."""
    spec = COLUMNS.get(f"{section}/{kind}", COLUMNS[section])
    cells = [_text(df, n, d) if i == len(spec) - 1 else F.rpad(_text(df, n, d), F.greatest(F.lit(w), F.length(_text(df, n, d))), F.lit(" ")) for i, (n, w, d) in enumerate(spec)]
    return df.select(F.lit(ORDER.index(section) + 1).alias("section_no"), F.col(order).cast("string").alias("ord_text"), F.coalesce(F.col(order).try_cast("double"), F.lit(0.0)).alias("ord"), F.rtrim(F.concat_ws(" ", *cells)).alias("text"))


def header(spark: SparkSession, section: str) -> DataFrame:
    names = [n for n, _, _ in COLUMNS[section]]
    line = " ".join([f";;{names[0]}".ljust(16), *(n.ljust(16) for n in names[1:])]).rstrip()
    lines = ["", f"[{section}]"] + ([] if section in ALWAYS else [line])
    return spark.createDataFrame([(ORDER.index(section) + 1, "", (i - 3) * 1e18, x) for i, x in enumerate(lines)], "section_no int, ord_text string, ord double, text string")


def options(spark: SparkSession, given: dict[str, str] | None = None) -> DataFrame:
    """OPTIONS rows: the defaults with the given ones put in; an unknown name raises ValueError."""
    if unknown := set(given or {}) - set(OPTIONS):
        raise ValueError(f"no options {sorted(unknown)}")
    pairs = [(i, k, v) for i, (k, v) in enumerate((OPTIONS | (given or {})).items()) if v != ""]
    return spark.createDataFrame(pairs, "n int, Option string, Value string")


def document(spark: SparkSession, sections: dict[str, tuple[DataFrame, str]], title: str = "", given: dict[str, str] | None = None) -> DataFrame:
    """(section_no, ord, ord_text, text) of a whole model in no order; empty sections but the first four are left out."""
    if unknown := set(sections) - set(ORDER):
        raise ValueError(f"no sections {sorted(unknown)}")
    fixed = {
        "TITLE": (spark.createDataFrame([(0, title)], "n int, Text string"), "n"),
        "OPTIONS": (options(spark, given), "n"),
        "EVAPORATION": (spark.createDataFrame([(0, "CONSTANT", "0"), (1, "DRY_ONLY", "NO")], "n int, Type string, Value string"), "n"),
        "REPORT": (spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate((("INPUT", "YES"), ("CONTROLS", "YES"), ("SUBCATCHMENTS", "ALL"), ("NODES", "ALL"), ("LINKS", "ALL")))], "n int, Item string, Value string"), "n"),
    }
    out = None
    for section in ORDER:
        df, order = (fixed | sections).get(section, (None, None))
        if df is None or (section not in ALWAYS and not df.take(1)):
            continue
        part = header(spark, section).unionByName(rows(section, df, order))
        out = part if out is None else out.unionByName(part)
    return out


def write(doc: DataFrame, path: str) -> None:
    """The model in order as text part files (their names sort as the lines do)."""
    doc.orderBy("section_no", "ord", "ord_text").select("text").write.mode("overwrite").text(path)


def rain_lines(series: DataFrame) -> DataFrame:
    """line: gage, year, month, day, hour, minute and the value with four decimals."""
    return series.select(F.format_string("%d   %s    %.4f", "rain_gage", F.date_format("date", "yyyy MM dd HH mm"), "value").alias("line"))


def read_rain(spark: SparkSession, path: str) -> DataFrame:
    """rain_gage, date, value of a rain file; lines that begin with ; are comments."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) != '' and trim(value) not like ';%'")
    n = lambda i: F.get(p, F.lit(i)).cast("int")
    return lines.select(F.get(p, F.lit(0)).alias("rain_gage"), F.make_timestamp_ntz(n(1), n(2), n(3), n(4), n(5), F.lit(0)).alias("date"), F.get(p, F.lit(6)).cast("double").alias("value"))


def series(results: DataFrame, name: str, attr: str) -> DataFrame:
    """(ts, value) of one element's attribute; an unknown element or attribute raises KeyError."""
    out = results.where((F.col("name") == name) & (F.col("attr") == attr)).select("ts", "value")
    if not out.take(1):
        raise KeyError(f"no series {name}/{attr}")
    return out


def interval_label(minutes: Column) -> Column:
    return hours_minutes(minutes)
