"""Column names, analytes and thresholds of the domain."""

from pyspark.sql import types as T

SITE = "MonitoringLocationIdentifier"
ANALYTE = "CharacteristicName"
DATE = "ActivityStartDate"
VALUE = "ResultMeasureValue"
UNIT = "ResultMeasure.MeasureUnitCode"
LAT = "LatitudeMeasure"
LON = "LongitudeMeasure"

# Names and numbers that decide the results.
RESULT_COLUMNS = [
    "OrganizationIdentifier",
    "MonitoringLocationIdentifier",
    "MonitoringLocationName",
    "MonitoringLocationTypeName",
    "ActivityStartDate",
    "LatitudeMeasure",
    "LongitudeMeasure",
    "CharacteristicName",
    "ResultMeasureValue",
    "ResultMeasure.MeasureUnitCode",
]
ANALYTES = ["pH", "Iron", "Manganese", "Aluminum", "Sulfate", "Alkalinity", "Specific conductance"]
SHORT_NAMES = {
    "Specific conductance": "Conductivity",
    "Iron": "Fe_mgL",
    "Manganese": "Mn_mgL",
    "Sulfate": "SO4_mgL",
    "Alkalinity": "Alk_mgL",
    "pH": "pH",
}
CONDUCTIVITY_UNITS = ["uS/cm", "µS/cm"]
PRESENT_RULES = [("pH", "<", 6.0), ("Fe_mgL", ">", 1.0), ("SO4_mgL", ">", 250.0)]
IMPACTED_RULES = [("pH_mean", "<", 5.0), ("Iron_mean", ">", 10.0)]
SENTINEL_LIMIT = 1e5
NUMERIC_TOKENS = ["MeasureValue", "Result", "Detection"]
TEXT_SUFFIXES = ("Code", "Text", "Name", "Identifier")
LAYER_TEXT_TOKENS = ["PROBLEM", "KEYWORD", "DESC", "TYPE", "ISSUE", "NOTES", "NAME"]
LAYER_WORDS = ["AMD", "ACID", "DRAINAGE", "SEEP", "DISCHARGE", "MINE WATER", "POLLUTION"]
LAT_NAMES = ["LatitudeMeasure", "Latitude", "MonitoringLocationLatitude", "DEC_LAT", "Lat"]
LON_NAMES = ["LongitudeMeasure", "Longitude", "MonitoringLocationLongitude", "DEC_LONG", "Lon"]
ID_NAMES = ["MonitoringLocationIdentifier", "ActivityIdentifier", "OrganizationIdentifier"]
SITE_NAME_TOKENS = ["name", "system", "site", "id"]
DISTANCE_NAMES = ["AML_dist_m", "Bituminous_dist_m"]
TREATMENT_COLUMNS = ["Fe", "pH_in", "pH_out", "CondIn", "CondOut", "TempIn", "TempOut", "Temperatur"]
TREATMENT_RENAMES = {
    "pH_in": "pH_In",
    "pH_out": "pH_Out",
    "CondIn": "Cond_In",
    "CondOut": "Cond_Out",
    "TempIn": "Temp_In",
    "TempOut": "Temp_Out",
    "Temperatur": "Temp",
}
DELTAS = [("pH_In", "pH_Out", "ΔpH"), ("Cond_In", "Cond_Out", "ΔCond"), ("Temp_In", "Temp_Out", "ΔTemp")]
DROP_PATTERN = r"(?i)(in$|out$|_left$|_right$|maintenanc|organization|monitoring|mineral|point_)"
DROP_KEEP = ["Bituminous_dist_m", "index_right"]
CHEMISTRY_TOKENS = [
    "ph", "cond", "specificconductance", "so4", "sulfate", "sulphate", "iron", "fe_", "mn",
    "manganese", "al", "aluminum", "acidity", "alkalinity", "tds", "total dissolved solids",
    "temp", "temperature",
]
IN_OUT_TOKENS = ["_in", "_out", " in", " out", "inlet", "outlet", "(in", "(out", " inflow", " outflow"]
HEALTH_CHEMISTRY = ["Fe", "ResultMeasureValue", "Temperatur"]
HEALTH_WEIGHTS = {"Iron_mean": 0.4, "Cond_mean": 0.4, "Temp_mean": 0.2}
CHEMISTRY_SHARE = 0.6
DISTANCE_SHARE = 0.4
PROXIMITY_FLOOR = 0.5
PROXIMITY_SHARE = 0.5
HOTSPOT_PH = 4.0
HOTSPOT_IRON = 10.0
HOTSPOT_SULFATE = 250.0
HOTSPOT_CONDUCTIVITY = 500.0
SEARCH_RADIUS_M = 5000.0
LINK_RADIUS_M = 250.0
SEED = 42

FEATURE = T.StructType([
    T.StructField("layer", T.StringType()),
    T.StructField("feature_id", T.StringType()),
    T.StructField("geometry_type", T.StringType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
    T.StructField("polygon_of", T.ArrayType(T.IntegerType())),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
