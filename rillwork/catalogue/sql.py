"""Pieces of SQL shared by the checks: the domain mapping in plain SQL."""

ANALYTE = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Alkalinity' WHEN 'AO' THEN 'Iron'
  WHEN 'NF' THEN 'Manganese' WHEN 'NO' THEN 'pH' WHEN 'RF' THEN 'Specific conductance'
  WHEN 'RO' THEN 'Sulfate' END"""

TYPE = """CASE {key} % 4 WHEN 0 THEN 'Stream' WHEN 1 THEN 'Mine Drainage' WHEN 2 THEN 'Outfall'
  ELSE 'Surface Water' END"""

X = "CAST(({key} * 7919) % 100003 AS DOUBLE)"
Y = "CAST(({key} * 104729) % 99991 AS DOUBLE)"
LON = "(" + X + " / 100003 * 5.8 - 80.5)"
LAT = "(" + Y + " / 99991 * 2.3 + 39.7)"

RESULTS = f"""results AS (
  SELECT 'ORG' || CAST(l_suppkey % 7 AS VARCHAR) AS org, 'S' || CAST(l_partkey AS VARCHAR) AS site,
    l_partkey AS site_key, {TYPE.format(key="l_partkey")} AS site_type,
    CAST(l_shipdate AS DATE) AS day, YEAR(l_shipdate) AS yr,
    {LAT.format(key="l_partkey")} AS lat, {LON.format(key="l_partkey")} AS lon,
    {ANALYTE} AS analyte,
    CASE {ANALYTE} WHEN 'pH' THEN l_quantity * 0.28 WHEN 'Iron' THEN l_extendedprice / 9973
      WHEN 'Sulfate' THEN l_extendedprice * 50 / 9973 ELSE l_extendedprice * 10 / 9973 END AS v,
    CASE WHEN {ANALYTE} = 'pH' THEN 'std units'
      WHEN {ANALYTE} = 'Specific conductance'
        THEN CASE l_linenumber % 3 WHEN 0 THEN 'uS/cm' WHEN 1 THEN 'µS/cm' ELSE 'mS/cm' END
      ELSE CASE l_linenumber % 3 WHEN 0 THEN 'mg/l' WHEN 1 THEN 'MG/L as CaCO3' ELSE 'ug/l' END
    END AS unit
  FROM lineitem)"""

QTEXT = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"

RAW = f"""raw AS (
  SELECT ' S' || CAST(l_partkey AS VARCHAR) AS site, {ANALYTE} AS analyte,
    CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day_text,
    CASE WHEN l_linenumber = 7 THEN '<' || {QTEXT} WHEN l_linenumber = 6 THEN ' ' || {QTEXT} || '.5 '
      WHEN l_linenumber = 5 THEN {QTEXT} || 'e1' WHEN l_linenumber = 4 THEN 'ND'
      WHEN l_linenumber = 3 THEN '-' || {QTEXT}
      WHEN l_linenumber = 2 AND l_quantity > 40 THEN '999999'
      WHEN l_linenumber = 2 THEN {QTEXT} || 'd' ELSE {QTEXT} END AS value_text,
    CASE WHEN l_linenumber = 1 THEN 'mg/l' ELSE 'MG/L as X' END AS unit
  FROM lineitem)"""


def number(text: str) -> str:
    pattern = r"\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*"
    return f"CASE WHEN regexp_full_match({text}, '{pattern}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


SITES = f"""sites AS (
  SELECT p_partkey AS site_key, 'S' || CAST(p_partkey AS VARCHAR) AS site,
    {X.format(key="p_partkey")} AS x, {Y.format(key="p_partkey")} AS y,
    {LON.format(key="p_partkey")} AS lon, {LAT.format(key="p_partkey")} AS lat,
    {TYPE.format(key="p_partkey")} AS site_type
  FROM part)"""

MINES = """mines AS (
  SELECT c_custkey AS id, c_name AS name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AML' WHEN 'BUILDING' THEN 'Bituminous'
      WHEN 'FURNITURE' THEN 'Anthracite' WHEN 'HOUSEHOLD' THEN 'Underground'
      WHEN 'MACHINERY' THEN 'Passive' END AS layer,
    CAST((c_custkey * 15485863) % 100003 AS DOUBLE) AS mx,
    CAST((c_custkey * 32452843) % 99991 AS DOUBLE) AS my
  FROM customer)"""

FLOW = """vertices AS (
  SELECT s_suppkey AS id, (s_suppkey * 99991 * 13) % 100003 AS x0, (s_suppkey * 86028121) % 99991 AS y0
  FROM supplier),
bends AS (
  SELECT id, x0, y0, x0 + (id % 7 - 3) * 1500 AS x1, y0 + (id % 5 - 2) * 1200 AS y1 FROM vertices),
flow AS (
  SELECT id, CAST(x0 AS DOUBLE) AS ax, CAST(y0 AS DOUBLE) AS ay,
    CAST(x1 AS DOUBLE) AS ex, CAST(y1 AS DOUBLE) AS ey FROM bends
  UNION ALL
  SELECT id, x1, y1, x1 + 2000, y1 + (id % 3 - 1) * 900 FROM bends)"""

WATERSHEDS = """watersheds AS (
  SELECT n_nationkey AS id, lpad(CAST(n_nationkey AS VARCHAR), 12, '0') AS huc12, n_name AS name,
    (n_nationkey % 5) * 20001 AS wx, (n_nationkey // 5) * 19999 AS wy FROM nation)"""

BASINS = """basins AS (
  SELECT lpad(CAST(r_regionkey AS VARCHAR), 10, '0') AS huc10, r_name AS name,
    r_regionkey * 20001 AS wx FROM region)"""

DISTANCE = "sqrt((x - mx) * (x - mx) + (y - my) * (y - my))"

TREATMENT = """treatment AS (
  SELECT 'S' || CAST(l_partkey AS VARCHAR) AS site, l_partkey AS site_key,
    CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice / 9973 END AS Fe,
    CASE WHEN l_linenumber <> 7 THEN l_quantity * 0.28 END AS pH_in,
    CASE WHEN l_linenumber NOT IN (6, 7) THEN l_quantity * 0.25 + l_tax * 10 END AS pH_out,
    CASE WHEN l_linenumber <> 7 THEN l_discount * 1000 END AS CondIn,
    CASE WHEN l_linenumber <> 7 THEN l_tax * 10000 END AS CondOut,
    CASE WHEN l_linenumber NOT IN (3, 7) THEN l_quantity / 5 + 5 END AS TempIn,
    CASE WHEN l_linenumber NOT IN (4, 7) THEN l_quantity / 4 + 6 END AS TempOut,
    CASE WHEN l_linenumber % 2 = 1 THEN l_quantity / 3 + 4 END AS Temperatur,
    l_discount * 50 AS IronIn,
    CASE WHEN l_linenumber <> 2 THEN l_tax * 100 END AS IronOut,
    CASE WHEN l_linenumber <> 1 THEN l_extendedprice * 10 / 9973 END AS v
  FROM lineitem)"""


def row_mean(*columns: str) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    present = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in columns)
    return f"(({total}) / nullif({present}, 0))"
