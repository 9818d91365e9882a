"""DuckDB SQL for the registered queries, written the way the study's scripts state the computation.

Self joins, one pass per characteristic, full outer joins and regular expressions: independent of how the Spark side
plans the same result.
"""

from __future__ import annotations

from catalog import nullable

ORACLES: dict[str, str] = {}

START, END = "1996-01-01", "2000-12-31"
LETTERS = "ABCDEFGHJKLMNPRSZX"

# Fixed values, stated a second time on purpose: the SQL must not depend on the library's lists.
CAUSES = ["s_underlying_cod_icd10"] + [f"s_cod_code_{k}" for k in range(1, 16)]
BANDS = [f"{a}-{a + 4}" for a in range(0, 90, 5)] + ["90+"]
ESP = [5000, 5500, 5500, 5500, 6000, 6000, 6500, 7000, 7000, 7000, 7000, 6500, 6000, 5500, 5000, 4000, 2500, 1500, 1000]
Z = "1.959963984540054"


def area_code(nation: str) -> str:
    return f"CASE {nation} % 5 WHEN 0 THEN 'E08000025' WHEN 1 THEN 'E08000029' ELSE 'E99999999' END"


def area_name(code: str) -> str:
    return f"CASE {code} WHEN 'E08000025' THEN 'Area A' WHEN 'E08000029' THEN 'Area B' END"


def ethnic_code(person: str) -> str:
    return f"substr('{LETTERS}', CAST(({person} * 7 + {person} // 100) % 18 + 1 AS INTEGER), 1)"


def two_digits(number: str) -> str:
    return f"lpad(CAST({number} AS VARCHAR), 2, '0')"


def age_group(age: str) -> str:
    return (
        f"CASE WHEN {age} < 16 THEN '0 - 15' WHEN {age} < 31 THEN '16 - 30' WHEN {age} < 46 THEN '31 - 45' "
        f"WHEN {age} < 61 THEN '46 - 60' WHEN {age} < 76 THEN '61 - 75' WHEN {age} < 91 THEN '76 - 90' "
        f"WHEN {age} >= 91 THEN '>= 91' END"
    )


def age_band(age: str) -> str:
    whens = " ".join(
        f"WHEN {age} >= {5 * i}" + (f" AND {age} < {5 * i + 5}" if i < 18 else "") + f" THEN '{b}'"
        for i, b in enumerate(BANDS)
    )
    return f"CASE {whens} END"


def icd_group(code: str) -> str:
    # fixed values: the study's patterns, in order
    rules = [
        ("^I0[0-2]", "Acute rheumatic fever"),
        ("^I0[5-9]", "Chronic rheumatic heart diseases"),
        ("^I1[0-5]", "Hypertensive diseases"),
        ("^I2[0-5]", "Ischaemic heart diseases"),
        ("^I2[6-8]", "Pulmonary heart disease and diseases of pulmonary circulation"),
        ("^I[3-4]\\d|I5[0-2]", "Other forms of heart disease"),
        ("^I6[0-9]", "Cerebrovascular diseases"),
        ("^I7[0-9]", "Diseases of arteries, arterioles and capillaries"),
        ("^I8[0-9]", "Diseases of veins, lymphatic vessels and lymph nodes, not elsewhere classified"),
        ("^I9[5-9]", "Chronic rheumatic heart diseases"),
    ]
    return "CASE " + " ".join(f"WHEN regexp_matches({code}, '{p}') THEN '{label}'" for p, label in rules) + " END"


def code_blocks(key: str) -> str:
    digits = f"CAST(1000000000000000000 + ({key} * 982451653 % 1000000007) * 999999937 AS VARCHAR)"
    return " || ".join(f"'{letter}' || substr({digits}, {2 + 3 * i}, 3)" for i, letter in enumerate("IJIIJI"))


def cause(k: int) -> str:
    at = f"(episode_id + {k})"
    code = f"substr(codes, 4 * ({at} % 6) + 1, CASE WHEN {at} % 17 = 0 THEN 2 ELSE 4 END)"
    missing = "" if k == 0 else f"WHEN {at} % 3 = 0 THEN NULL "
    return f"CASE {missing}WHEN {at} % 11 = 0 THEN 'NULL' ELSE {code} END"


# --- shared shapes ---------------------------------------------------------------------------------------------------

PERSON = f"""person AS (
  SELECT o_orderkey AS episode_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS event_date,
    CASE WHEN o_custkey % 97 <> 0 THEN CAST(o_custkey % 100 AS INTEGER) END AS age,
    CASE WHEN o_custkey % 89 <> 0 THEN 'L' || {two_digits("c_nationkey")} END AS lsoa,
    {area_code("c_nationkey")} AS la_code, {ethnic_code("o_custkey")} AS ethnic_code, o_orderpriority AS method
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

REGISTER = PERSON + f""", register AS (
  SELECT CASE WHEN person_id % 53 <> 0 THEN CAST(person_id AS VARCHAR) END AS patient_id,
    CAST(person_id % 3 AS INTEGER) AS sex, 'M' || CAST(episode_id // 2 % 2 AS VARCHAR) AS marital_status,
    'P' || CAST(episode_id // 4 % 2 AS VARCHAR) AS place_of_death_code, age, lsoa,
    la_code AS residence_la_code, ethnic_code, event_date AS reg_date, 1 + episode_id % 3 AS deaths_weight,
    episode_id AS record_id, {", ".join(f"{cause(k)} AS {c}" for k, c in enumerate(CAUSES))}
  FROM (SELECT *, {code_blocks("episode_id")} AS codes FROM person))"""

LONG = REGISTER + f""", long AS (
  SELECT * FROM (UNPIVOT register ON {", ".join(CAUSES)} INTO NAME cause_number VALUE icd10_code)
  WHERE icd10_code <> 'NULL')"""

LOOKUPS = f"""lsoa_lookup AS (
  SELECT {two_digits("n_nationkey")} AS no, r_name AS locality, n_nationkey % 10 + 1 AS imd_decile,
    (n_nationkey % 10 + 2) // 2 AS imd_quintile
  FROM nation JOIN region ON n_regionkey = r_regionkey),
coding AS (SELECT * FROM (VALUES ('A', 'White - British'), ('B', 'White - Irish'),
  ('C', 'White - Any other White background'), ('D', 'Mixed - White and Black Caribbean'),
  ('E', 'Mixed - White and Black African'), ('F', 'Mixed - White and Asian'),
  ('G', 'Mixed - Any other mixed background'), ('H', 'Asian or Asian British - Indian'),
  ('J', 'Asian or Asian British - Pakistani'), ('K', 'Asian or Asian British - Bangladeshi'),
  ('L', 'Asian or Asian British - Any other Asian background'), ('M', 'Black or Black British - Caribbean'),
  ('N', 'Black or Black British - African'), ('P', 'Black or Black British - Any other Black background'),
  ('R', 'Other Ethnic Groups - Chinese'), ('S', 'Other Ethnic Groups - Any other ethnic group')) t(code, label)),
clinical AS (
  SELECT DISTINCT CASE WHEN p_partkey % 100 % 23 = 5 THEN 'K' ELSE 'I' END || {two_digits("p_partkey % 100")} AS code,
    'Group ' || CAST(p_partkey % 100 // 50 AS VARCHAR) AS clinical_group,
    CASE WHEN p_partkey % 100 % 17 = 0 THEN 'Not CVD' ELSE 'Subgroup ' || CAST(p_partkey % 100 // 10 AS VARCHAR) END
      AS clinical_subgroup
  FROM part),
listing AS (
  SELECT CASE WHEN p_partkey % 50 = 49 THEN substr(full_code, 1, 2) ELSE full_code END AS icd10_code,
    p_name || ' ' || CAST(p_partkey AS VARCHAR) AS icd10_short_title, p_type AS simplified_cause,
    p_partkey AS position
  FROM (SELECT *, CASE WHEN p_partkey % 23 = 0 THEN 'J' ELSE 'I' END || {two_digits("p_partkey % 100")}
      || CAST(p_partkey // 100 % 10 AS VARCHAR) AS full_code FROM part)),
titles AS (
  SELECT icd_subgroup, icd10_short_title, simplified_cause FROM (
    SELECT *, row_number() OVER (PARTITION BY icd_subgroup ORDER BY position) AS rn
    FROM (SELECT *, CASE WHEN length(icd10_code) >= 3 THEN substr(icd10_code, 1, 3) END AS icd_subgroup FROM listing))
  WHERE rn = 1),
titles_i AS (
  SELECT icd_subgroup, icd10_short_title, simplified_cause FROM (
    SELECT *, row_number() OVER (PARTITION BY icd_subgroup ORDER BY position) AS rn
    FROM (SELECT *, nullif(regexp_extract(icd10_code, 'I\\d{{2}}'), '') AS icd_subgroup FROM listing))
  WHERE rn = 1),
methods AS (SELECT * FROM (VALUES ('1-URGENT', 'Emergency'), ('2-HIGH', 'Emergency'), ('3-MEDIUM', 'Elective'),
  ('4-NOT SPECIFIED', 'Elective')) t(description, admission_group))"""

DEATHS = (
    LONG
    + ", "
    + LOOKUPS
    + f""", coded AS (
  SELECT *, substr(icd10_code, 1, 3) AS icd_subgroup, {icd_group("icd10_code")} AS cvd_group
  FROM long WHERE length(icd10_code) >= 3 AND icd10_code LIKE 'I%'),
deduplicated AS (
  -- every column of the extract but the causes; deaths without a person are never the same
  SELECT DISTINCT patient_id, CASE WHEN patient_id IS NULL THEN record_id END AS unlinked, sex, marital_status,
    place_of_death_code, age, lsoa, residence_la_code, ethnic_code, icd_subgroup, cvd_group FROM coded),
underlying AS (
  SELECT patient_id, sex, age, lsoa, residence_la_code, ethnic_code, icd_subgroup, cvd_group
  FROM coded WHERE cause_number = 's_underlying_cod_icd10')"""
)


def deaths(scope: str, grouping: str) -> str:
    source = "underlying" if scope == "primary" else "deduplicated"
    drop = "WHERE clinical_subgroup <> 'Not CVD'" if grouping == "clinical" else ""
    return (
        DEATHS
        + f""", base AS (
  SELECT d.patient_id, CASE d.sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex, d.age, d.icd_subgroup,
    d.cvd_group, l.locality, l.imd_decile, l.imd_quintile, coalesce(e.label, 'Unknown') AS ethnicity,
    c.clinical_group, c.clinical_subgroup, t.icd10_short_title, {age_group("d.age")} AS age_group,
    {area_name("d.residence_la_code")} AS local_authority,
    CASE WHEN d.age < 75 THEN 74.5 - d.age WHEN d.age >= 75 THEN 0 END AS yll
  FROM {source} d
  LEFT JOIN lsoa_lookup l ON d.lsoa IS NOT DISTINCT FROM 'L' || l.no
  LEFT JOIN coding e ON d.ethnic_code IS NOT DISTINCT FROM e.code
  LEFT JOIN clinical c ON d.icd_subgroup IS NOT DISTINCT FROM c.code
  LEFT JOIN titles t ON d.icd_subgroup IS NOT DISTINCT FROM t.icd_subgroup {drop})"""
    )


ADMISSIONS = (
    PERSON
    + ", "
    + LOOKUPS
    + f""", admissions AS (
  SELECT a.*, l.locality, l.imd_decile, l.imd_quintile, coalesce(e.label, 'Unknown') AS ethnicity,
    c.clinical_group, c.clinical_subgroup, t.icd10_short_title, m.admission_group,
    m.admission_group = 'Emergency' AS emergency, {age_group("age_on_admission")} AS age_group,
    CASE WHEN age_on_admission < 75 THEN 'Under 75' ELSE '75 and over' END AS age_category,
    {icd_group("a.icd_subgroup")} AS cvd_group
  FROM (
    SELECT episode_id, 'I' || {two_digits("(episode_id * 7 % 100)")} AS icd_subgroup, age AS age_on_admission,
      CASE person_id % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Not known' END AS gender, lsoa,
      {area_name("la_code")} AS local_authority, 'GP' || {two_digits("(person_id % 40)")} AS gp_code, ethnic_code,
      method AS admission_method_description
    FROM person) a
  LEFT JOIN lsoa_lookup l ON a.lsoa IS NOT DISTINCT FROM 'L' || l.no
  LEFT JOIN coding e ON a.ethnic_code IS NOT DISTINCT FROM e.code
  LEFT JOIN clinical c ON a.icd_subgroup IS NOT DISTINCT FROM c.code
  LEFT JOIN titles_i t ON a.icd_subgroup IS NOT DISTINCT FROM t.icd_subgroup
  LEFT JOIN methods m ON a.method_key IS NOT DISTINCT FROM m.description)""".replace(
        "a.method_key", "a.admission_method_description"
    )
)

# Census 2021 ethnic group -> ethnic category used in health records.
CENSUS_LABELS = [
    ("Asian, Asian British or Asian Welsh: Bangladeshi", "Asian or Asian British - Bangladeshi"),
    ("Asian, Asian British or Asian Welsh: Chinese", "Other Ethnic Groups - Chinese"),
    ("Asian, Asian British or Asian Welsh: Indian", "Asian or Asian British - Indian"),
    ("Asian, Asian British or Asian Welsh: Pakistani", "Asian or Asian British - Pakistani"),
    ("Asian, Asian British or Asian Welsh: Other Asian", "Asian or Asian British - Any other Asian background"),
    ("Black, Black British, Black Welsh, Caribbean or African: African", "Black or Black British - African"),
    ("Black, Black British, Black Welsh, Caribbean or African: Caribbean", "Black or Black British - Caribbean"),
    (
        "Black, Black British, Black Welsh, Caribbean or African: Other Black",
        "Black or Black British - Any other Black background",
    ),
    ("Mixed or Multiple ethnic groups: White and Asian", "Mixed - White and Asian"),
    ("Mixed or Multiple ethnic groups: White and Black African", "Mixed - White and Black African"),
    ("Mixed or Multiple ethnic groups: White and Black Caribbean", "Mixed - White and Black Caribbean"),
    (
        "Mixed or Multiple ethnic groups: Other Mixed or Multiple ethnic groups",
        "Mixed - Any other mixed background",
    ),
    ("White: English, Welsh, Scottish, Northern Irish or British", "White - British"),
    ("White: Irish", "White - Irish"),
    ("White: Gypsy or Irish Traveller", "White - Any other White background"),
    ("White: Roma", "White - Any other White background"),
    ("White: Other White", "White - Any other White background"),
    ("Other ethnic group: Arab", "Other Ethnic Groups - Any other ethnic group"),
    ("Other ethnic group: Any other ethnic group", "Other Ethnic Groups - Any other ethnic group"),
]

CENSUS = f"""labels AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(CENSUS_LABELS))},
  (19, 'Does not apply', NULL)) t(no, ethnic_group_20, ethnicity)),
census AS (
  SELECT c.*, {age_band("age_code")} AS age_band, l.imd_decile, l.imd_quintile
  FROM (SELECT least(c_custkey % 100, 90) AS age_code, ethnic_group_20, ethnicity,
      CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, {two_digits("c_nationkey")} AS no,
      1000 + c_custkey % 7 AS observation
    FROM customer JOIN labels ON labels.no = (c_custkey * 7 + c_custkey // 100) % 20) c
  LEFT JOIN lsoa_lookup l ON c.no = l.no)"""

STDPOP = (
    "stdpop AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{b}', {w})" for b, w in zip(BANDS, ESP, strict=True))
    + ") t(age_band, w))"
)


def add(name: str, ctes: str, body: str) -> None:
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in nullable.NUMBERS.get(name, [])]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c in nullable.FLAGS.get(name, [])]
    if casts:
        body = f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{body}\n)"
    ORACLES[name] = f"WITH {ctes}\n{body}" if ctes else body


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


# --- extracts and episodes -------------------------------------------------------------------------------------------

EXTRACT_COLUMNS = (
    "nhs_number, diagnosis_group, provider_code, provider_name, local_authority, constituency, lsoa_2011, lsoa_2021, "
    "gp_code, ethnic_code, ethnic_grouping, gender, age_on_admission, {date} AS admission_date, "
    "admission_source_code, admission_source_description, admission_method_code, admission_method_description, "
    "episode_id"
)

EXTRACT = f"""diagnosis AS (
  SELECT l_orderkey AS episode_id, CASE WHEN l_partkey % 97 <> 0 THEN 'P' || CAST(l_partkey AS VARCHAR) END AS nhs_number,
    CASE WHEN l_orderkey % 10 = 0 THEN 'J' ELSE 'I' END || {two_digits("(l_partkey % 100)")}
      || CAST(l_orderkey % 10 AS VARCHAR) AS diagnosis_code,
    l_linenumber AS diagnosis_order, l_suppkey % 2 + 1 AS order_in_spell, 'S' || CAST(l_suppkey AS VARCHAR) AS provider_code,
    'Provider ' || CAST(l_suppkey AS VARCHAR) AS provider_name,
    CASE WHEN l_partkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS gender,
    CAST(l_partkey % 100 AS INTEGER) AS age_on_admission, CAST(l_shipdate AS DATE) AS admission_date,
    l_linestatus AS admission_source_code, 'Source ' || l_linestatus AS admission_source_description,
    l_returnflag AS admission_method_code, 'Method ' || l_returnflag AS admission_method_description
  FROM lineitem),
geography AS (
  SELECT o_orderkey AS geo_episode, {area_code("c_nationkey")} AS local_authority,
    'Constituency ' || CAST(c_nationkey AS VARCHAR) AS constituency, 'L' || {two_digits("c_nationkey")} AS lsoa_2011,
    'M' || {two_digits("c_nationkey")} AS lsoa_2021, 'GP' || {two_digits("(o_custkey % 40)")} AS gp_code
  FROM orders JOIN customer ON o_custkey = c_custkey),
people AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS pseudo, substr('{LETTERS}', p_size % 18 + 1, 1) AS ethnic_code,
    p_type AS ethnic_grouping FROM part),
all_data AS (
  SELECT *, substr(diagnosis_code, 1, 3) AS diagnosis_group
  FROM diagnosis LEFT JOIN geography ON episode_id = geo_episode LEFT JOIN people ON nhs_number = pseudo
  WHERE diagnosis_code LIKE 'I%' AND diagnosis_order = 1 AND order_in_spell = 1
    AND admission_date >= DATE '{START}' AND admission_date < DATE '{END}'
    AND local_authority IN ('E08000025', 'E08000029') AND nhs_number IS NOT NULL)"""

add(
    "extract_admissions_rows",
    EXTRACT,
    f"SELECT {EXTRACT_COLUMNS.format(date='CAST(admission_date AS VARCHAR)')} FROM all_data",
)
for name, days in (("admission_cohort", 90), ("admission_cohort_in_order", 30), ("bucketed_cohort", 90)):
    add(
        name,
        EXTRACT
        + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY nhs_number, diagnosis_group
    ORDER BY admission_date, episode_id, provider_code) AS rn FROM all_data)""",
        f"""SELECT {EXTRACT_COLUMNS.format(date="CAST(admission_date AS VARCHAR)")}, rn FROM numbered a
WHERE NOT EXISTS (SELECT 1 FROM numbered b WHERE a.nhs_number = b.nhs_number
  AND a.diagnosis_group = b.diagnosis_group AND a.rn = b.rn + 1
  AND a.admission_date <= b.admission_date + INTERVAL {days} DAY)""",
    )
add(
    "extract_admissions_numbered",
    EXTRACT,
    f"""SELECT {EXTRACT_COLUMNS.format(date="CAST(admission_date AS VARCHAR)")},
  row_number() OVER (PARTITION BY nhs_number, diagnosis_group ORDER BY admission_date, episode_id) AS rn FROM all_data""",
)
add(
    "admission_episodes",
    EXTRACT
    + """, marked AS (
  SELECT nhs_number, diagnosis_group, admission_date, coalesce(admission_date > lag(admission_date) OVER w
    + INTERVAL 90 DAY, true) AS opens FROM all_data
  WINDOW w AS (PARTITION BY nhs_number, diagnosis_group ORDER BY admission_date)),
islands AS (
  SELECT *, sum(opens::INTEGER) OVER (PARTITION BY nhs_number, diagnosis_group ORDER BY admission_date
    RANGE UNBOUNDED PRECEDING) AS island FROM marked)""",
    """SELECT nhs_number, diagnosis_group, CAST(min(admission_date) AS VARCHAR) AS start,
  CAST(max(admission_date) AS VARCHAR) AS "end", count(*) AS admissions FROM islands
GROUP BY nhs_number, diagnosis_group, island""",
)
add(
    "elective_without_recent_emergency",
    PERSON,
    """SELECT episode_id, CAST(person_id AS VARCHAR) AS nhs_number, CAST(event_date AS VARCHAR) AS admission_date,
  method AS admission_method_description
FROM person a WHERE method <> '1-URGENT' AND NOT EXISTS (
  SELECT 1 FROM person b WHERE b.method = '1-URGENT' AND a.person_id = b.person_id
    AND b.event_date <= a.event_date AND a.event_date <= b.event_date + INTERVAL 120 DAY)""",
)
add(
    "record_index",
    "",
    """SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS index
FROM orders""",
)
add(
    "first_title_in_file_order",
    LOOKUPS,
    """SELECT icd10_code, icd10_short_title, icd_subgroup FROM (
  SELECT *, row_number() OVER (PARTITION BY icd_subgroup ORDER BY position) AS rn
  FROM (SELECT *, CASE WHEN length(icd10_code) >= 3 THEN substr(icd10_code, 1, 3) END AS icd_subgroup FROM listing))
WHERE rn = 1""",
)
add(
    "first_admission_in_gap",
    REGISTER
    + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY person, chapter ORDER BY admitted, record_id) AS rn FROM (
    SELECT CASE WHEN CAST(patient_id AS BIGINT) % 97 <> 0 THEN patient_id END AS person,
      substr(s_underlying_cod_icd10, 1, 1) AS chapter, reg_date AS admitted, record_id FROM register))""",
    """SELECT a.person, a.chapter, CAST(a.admitted AS VARCHAR) AS admitted, a.record_id
FROM numbered a LEFT JOIN numbered b ON a.person = b.person AND a.chapter = b.chapter AND a.rn = b.rn + 1
  AND a.admitted <= b.admitted + INTERVAL 90 DAY
WHERE b.person IS NULL""",
)
PATIENT_INDEX = f"""patient_index AS (
  SELECT CASE WHEN o_custkey % 97 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS pseudo_nhs_number,
    CASE WHEN o_orderkey % 13 <> 0 THEN substr('{LETTERS}', CAST(o_orderkey % 18 + 1 AS INTEGER), 1) END AS ethnic_code,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS ethnicity_category,
    CAST(o_orderdate AS DATE) AS recorded, o_orderkey AS record_id
  FROM orders)"""
add(
    "ethnicity_numbered",
    PATIENT_INDEX,
    """SELECT * REPLACE (CAST(recorded AS VARCHAR) AS recorded),
  row_number() OVER (ORDER BY pseudo_nhs_number, recorded, record_id) AS rn FROM patient_index
WHERE ethnicity_category <> '' AND ethnic_code <> 'Z' AND pseudo_nhs_number IS NOT NULL""",
)
add(
    "latest_ethnicity",
    PATIENT_INDEX
    + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pseudo_nhs_number ORDER BY recorded DESC, record_id DESC) AS rn
  FROM patient_index
  WHERE ethnicity_category IS NOT NULL AND ethnicity_category NOT LIKE '' AND ethnic_code != 'Z'
    AND pseudo_nhs_number IS NOT NULL)""",
    """SELECT pseudo_nhs_number, ethnic_code, ethnicity_category, CAST(recorded AS VARCHAR) AS recorded, record_id
FROM numbered WHERE rn = 1""",
)
EXTRACTED_DEATHS = f"""SELECT patient_id, sex, age, lsoa, residence_la_code, record_id, {", ".join(CAUSES)},
  c_mktsegment AS ethnic_grouping, CAST(c_custkey % 2 AS INTEGER) AS is_deceased,
  {ethnic_code("c_custkey")} AS ethnic_code
FROM register LEFT JOIN customer ON patient_id = CAST(c_custkey AS VARCHAR)
WHERE reg_date >= DATE '{START}' AND reg_date <= DATE '{END}' AND residence_la_code IN ('E08000025', 'E08000029')"""
ANY_CODE = " OR ".join(f"{c} LIKE 'I%'" for c in CAUSES)
add("extract_deaths_rows", REGISTER, EXTRACTED_DEATHS)
add("death_cohort_rows", REGISTER, f"SELECT * FROM ({EXTRACTED_DEATHS}) WHERE {ANY_CODE}")
add(
    "any_code_filter_counts",
    REGISTER,
    f"""SELECT residence_la_code, count(*) AS n,
  count(*) FILTER (WHERE s_underlying_cod_icd10 LIKE 'I%') AS n_underlying
FROM register WHERE {ANY_CODE} GROUP BY residence_la_code""",
)

WEIGHTED = (
    REGISTER
    + ", "
    + LOOKUPS
    + f""", weighted AS (
  SELECT residence_la_code, {area_name("residence_la_code")} AS local_authority, s_underlying_cod_icd10 AS cause,
    deaths_weight AS deaths, CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex, age, lsoa,
    {icd_group("s_underlying_cod_icd10")} AS cvd_group,
    nullif(regexp_extract(s_underlying_cod_icd10, 'I\\d{{2}}'), '') AS icd_subgroup, {age_group("age")} AS age_group,
    CASE WHEN age < 75 THEN (74.5 - age) * deaths_weight WHEN age >= 75 THEN 0 END AS yll
  FROM register WHERE record_id % 2 = 0 OR residence_la_code = 'E08000025'),
base AS (
  SELECT w.*, t.icd10_short_title, l.locality, l.imd_quintile, c.clinical_group, c.clinical_subgroup
  FROM weighted w LEFT JOIN titles_i t ON w.icd_subgroup IS NOT DISTINCT FROM t.icd_subgroup
  LEFT JOIN lsoa_lookup l ON w.lsoa IS NOT DISTINCT FROM 'L' || l.no
  LEFT JOIN clinical c ON w.icd_subgroup IS NOT DISTINCT FROM c.code)"""
)
add(
    "conform_union_counts",
    WEIGHTED,
    """SELECT residence_la_code, sex, count(*) AS n, CAST(sum(deaths) AS BIGINT) AS deaths
FROM weighted GROUP BY residence_la_code, sex""",
)

# --- reshape and classify ---------------------------------------------------------------------------------------------

add(
    "unpivot_causes",
    LONG,
    """SELECT cause_number, count(*) AS n, count(*) FILTER (WHERE length(icd10_code) < 3) AS n_short
FROM long GROUP BY cause_number""",
)
add(
    "primary_cause_rows",
    REGISTER,
    "SELECT residence_la_code, count(*) AS n FROM register WHERE s_underlying_cod_icd10 LIKE 'I%' GROUP BY 1",
)
add("icd_group_counts", LONG, f"SELECT {icd_group('icd10_code')} AS cvd_group, count(*) AS n FROM long GROUP BY 1")
add(
    "icd_subgroup_forms",
    LONG,
    """SELECT substr(icd10_code, 1, 3) AS prefix, nullif(regexp_extract(icd10_code, '^.{3}'), '') AS strict,
  nullif(regexp_extract(icd10_code, 'I\\d{2}'), '') AS matched, count(*) AS n FROM long GROUP BY 1, 2, 3""",
)
add("first_per_key_lookup", LOOKUPS, "SELECT icd10_short_title, simplified_cause, icd_subgroup FROM titles")
add("first_per_key_pattern", LOOKUPS, "SELECT icd10_short_title, simplified_cause, icd_subgroup FROM titles_i")
add(
    "distinct_causes_by_person",
    DEATHS,
    "SELECT icd_subgroup, cvd_group, count(*) AS n FROM deduplicated GROUP BY 1, 2",
)
add(
    "distinct_cause_rows",
    DEATHS,
    """SELECT residence_la_code, icd_subgroup, cvd_group, count(*) AS n FROM (
  SELECT DISTINCT patient_id, sex, marital_status, place_of_death_code, age, lsoa, residence_la_code, ethnic_code,
    reg_date, icd_subgroup, cvd_group FROM coded)
GROUP BY 1, 2, 3""",
)
add(
    "distinct_causes_by_record",
    DEATHS,
    """SELECT icd_subgroup, cvd_group, count(*) AS n
FROM (SELECT DISTINCT record_id, icd_subgroup, cvd_group FROM coded) GROUP BY 1, 2""",
)
add(
    "age_group_counts",
    REGISTER,
    f"""SELECT {age_group("age")} AS age_group, CASE WHEN age < 16 THEN 1 WHEN age < 31 THEN 2 WHEN age < 46 THEN 3
  WHEN age < 61 THEN 4 WHEN age < 76 THEN 5 WHEN age < 91 THEN 6 WHEN age >= 91 THEN 7 END AS age_group_ord,
  count(*) AS n FROM register GROUP BY 1, 2""",
)
add(
    "five_year_band_counts",
    REGISTER,
    f"""SELECT {age_band("(age - 3)")} AS age_band,
  CASE WHEN age - 3 >= 90 THEN 19 WHEN age - 3 >= 0 THEN (age - 3) // 5 + 1 END AS age_band_ord, count(*) AS n
FROM register GROUP BY 1, 2""",
)
add(
    "two_age_categories",
    REGISTER,
    """SELECT CASE WHEN age < 75 THEN 'Under 75' ELSE '75 and over' END AS age_category, count(*) AS n
FROM register GROUP BY 1""",
)
add(
    "sex_factor_and_default",
    REGISTER,
    """SELECT CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex_factor,
  CASE WHEN sex = 1 THEN 'Male' ELSE 'Female' END AS sex_default, count(*) AS n FROM register GROUP BY 1, 2""",
)
add(
    "ethnicity_split",
    PERSON + ", " + LOOKUPS,
    """SELECT ethnicity, regexp_replace(ethnicity, '-.*', '') AS broad,
  CASE regexp_replace(ethnicity, '^.*?-', '') WHEN ' British' THEN ' White British'
    ELSE regexp_replace(ethnicity, '^.*?-', '') END AS detail, count(*) AS n
FROM (SELECT coalesce(label, 'Unknown') AS ethnicity FROM person LEFT JOIN coding ON ethnic_code = code)
GROUP BY 1, 2, 3""",
)
add(
    "census_label_map",
    LOOKUPS + ", " + CENSUS,
    """SELECT ethnic_group_20, ethnicity, CAST(sum(observation) AS BIGINT) AS population_count
FROM census GROUP BY 1, 2""",
)
add(
    "quintiles_and_levels",
    PERSON + ", " + LOOKUPS,
    """SELECT imd_decile, CAST(floor(floor(imd_decile + 1) / 2) AS INTEGER) AS from_decile,
  CASE WHEN imd_decile IN (1, 2, 3, 4, 5) THEN imd_decile END AS low_levels, count(*) AS n
FROM person LEFT JOIN lsoa_lookup ON lsoa = 'L' || no GROUP BY 1, 2, 3""",
)

# --- joins --------------------------------------------------------------------------------------------------------------

NULL_LOOKUP = """, with_null AS (
  SELECT 'L' || no AS key, locality, imd_quintile FROM lsoa_lookup
  UNION ALL SELECT NULL, 'No fixed place', NULL)"""
add(
    "lookup_join_null_safe",
    PERSON + ", " + LOOKUPS + NULL_LOOKUP,
    """SELECT locality, imd_quintile, count(*) AS n
FROM person LEFT JOIN with_null ON lsoa IS NOT DISTINCT FROM key GROUP BY 1, 2""",
)
add(
    "lookup_join_sql_rule",
    PERSON + ", " + LOOKUPS + NULL_LOOKUP,
    "SELECT locality, count(*) AS n FROM person LEFT JOIN with_null ON lsoa = key GROUP BY 1",
)
add(
    "lookup_join_salted",
    "",
    """SELECT c_mktsegment AS ethnic_grouping, CAST(c_custkey % 2 AS INTEGER) AS is_deceased, count(*) AS n
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_custkey % 53 <> 0 GROUP BY 1, 2""",
)
add(
    "lookup_duplicate_keys",
    LOOKUPS,
    """SELECT CASE WHEN length(icd10_code) >= 3 THEN substr(icd10_code, 1, 3) END AS icd_subgroup, count(*) AS n
FROM listing GROUP BY 1 HAVING count(*) > 1""",
)
add(
    "counts_join_population",
    PERSON + ", " + LOOKUPS + ", " + CENSUS,
    f"""SELECT coalesce(a.age, p.age_code) AS age_code, {r6("a.n")} AS n, p.population_count
FROM (SELECT age, count(*) / 10.0::DOUBLE AS n FROM person GROUP BY age) a
FULL JOIN (SELECT CAST(age_code AS INTEGER) AS age_code, CAST(sum(observation) AS BIGINT) AS population_count
  FROM census GROUP BY 1) p ON a.age IS NOT DISTINCT FROM p.age_code""",
)
MULTI_CAUSE = LONG + f""", sources AS (
  SELECT DISTINCT record_id, residence_la_code, sex, substr(icd10_code, 1, 3) AS icd_subgroup,
    {icd_group("icd10_code")} AS cvd_group
  FROM long WHERE (record_id % 2 = 0 OR residence_la_code = 'E08000025') AND icd10_code LIKE 'I%'
    AND length(icd10_code) >= 3 AND cause_number IN ({", ".join(f"'{c}'" for c in CAUSES[:8])}))"""
add(
    "deaths_multi_cause_by_area",
    MULTI_CAUSE,
    "SELECT residence_la_code, icd_subgroup, cvd_group, count(*) AS n FROM sources GROUP BY 1, 2, 3",
)
add("deaths_multi_cause_by_sex", MULTI_CAUSE, "SELECT sex, cvd_group, count(*) AS n FROM sources GROUP BY 1, 2")


def profile(side: str, source: str, columns: dict[str, str]) -> str:
    """(column_name, type, rows, nulls, distinct values) of the named columns, one SELECT for each."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS {side}_type, count(*) AS {side}_rows, count(*) - count({c}) AS {side}_nulls, "
        f"count(DISTINCT {c}) AS {side}_distinct_values FROM {source}"
        for c, t in columns.items()
    )


REGISTER_TYPES = {
    "patient_id": "string",
    "sex": "int",
    "marital_status": "string",
    "place_of_death_code": "string",
    "age": "int",
    "lsoa": "string",
    "residence_la_code": "string",
    "ethnic_code": "string",
    "deaths_weight": "bigint",
    "record_id": "bigint",
}
ADMISSION_TYPES = {
    "episode_id": "bigint",
    "nhs_number": "string",
    "diagnosis_group": "string",
    "age_on_admission": "int",
    "gender": "string",
    "lsoa_2011": "string",
    "local_authority": "string",
    "gp_code": "string",
    "ethnic_code": "string",
    "admission_method_description": "string",
}
add(
    "schema_difference",
    REGISTER
    + f""", raw_admissions AS (
  SELECT episode_id, CAST(person_id AS VARCHAR) AS nhs_number, 'I' || {two_digits("(episode_id * 7 % 100)")}
      AS diagnosis_group, age AS age_on_admission, person_id % 3 AS gender, lsoa AS lsoa_2011, la_code AS local_authority,
    person_id % 40 AS gp_code, ethnic_code, method AS admission_method_description FROM person),
a AS ({profile("first", "register", REGISTER_TYPES)}),
b AS ({profile("second", "raw_admissions", ADMISSION_TYPES)})""",
    "SELECT * FROM a FULL JOIN b USING (column_name)",
)
add("row_id_uniqueness", "", 'SELECT count(*) AS ids, count(*) AS "rows" FROM orders')

# --- deaths and years of life lost --------------------------------------------------------------------------------------

GROUPINGS = {"clinical": ("clinical_subgroup", "clinical_group"), "icd10": ("icd10_short_title", "cvd_group")}
NULL_SUM = "CASE WHEN count({0}) = count(*) THEN sum({0}) END"


def by_area(keys: tuple[str, ...], measures: str) -> str:
    areas = {"Area A": "'Area A'", "Area B": "'Area B'", "Both areas": "'Area A', 'Area B'"}
    return "\nUNION ALL\n".join(
        f"SELECT {', '.join(keys)}, '{label}' AS area, {measures} FROM base WHERE local_authority IN ({members}) "
        f"GROUP BY {', '.join(keys)}"
        for label, members in areas.items()
    )


def by_characteristic(keys: tuple[str, ...], characteristics: list[str], measures: str, table: str = "base") -> str:
    lead = "".join(f"{k}, " for k in keys)
    return "\nUNION ALL\n".join(
        f"SELECT {lead}'{c}' AS characteristic, CAST({c} AS VARCHAR) AS level, {measures} FROM {table} "
        f"GROUP BY {lead}{c}"
        for c in characteristics
    )


DEATH_MEASURES = f"{r6('count(*) / 10.0::DOUBLE')} AS deaths, {r6(NULL_SUM.format('yll') + ' / 10.0::DOUBLE')} AS yll"
WEIGHTED_MEASURES = (
    f"{r6('sum(deaths) / 10.0::DOUBLE')} AS deaths, {r6(NULL_SUM.format('yll') + ' / 10.0::DOUBLE')} AS yll"
)
AGE_ORDER = (
    "CASE WHEN age < 16 THEN 1 WHEN age < 31 THEN 2 WHEN age < 46 THEN 3 WHEN age < 61 THEN 4 WHEN age < 76 THEN 5 "
    "WHEN age < 91 THEN 6 WHEN age >= 91 THEN 7 END"
)


def by_age(keys: tuple[str, ...], count: str) -> str:
    lead = ", ".join(keys)
    return (
        f"SELECT {lead}, age_group, {AGE_ORDER} AS age_group_ord, {r6(f'{count} / 10.0::DOUBLE')} AS deaths "
        f"FROM base GROUP BY {lead}, age_group, age_group_ord"
    )


def share(key: str, outcome: str, amount: str = "count(*)", table: str = "base") -> str:
    return (
        f"SELECT {key}, {outcome}, total_{outcome}, "
        f"{r6(f'100.0::DOUBLE * {outcome} / total_{outcome}')} AS percentage_{outcome} FROM ("
        f"SELECT *, CAST(sum({outcome}) OVER () AS BIGINT) AS total_{outcome} FROM ("
        f"SELECT {key}, CAST({amount} AS BIGINT) AS {outcome} FROM {table} GROUP BY {key}))"
    )


for scope in ("primary", "all_cause"):
    for grouping, keys in GROUPINGS.items():
        base = deaths(scope, grouping)
        add(f"deaths_yll_by_area_{scope}_{grouping}", base, by_area(keys, DEATH_MEASURES))
        add(
            f"deaths_yll_by_characteristic_{scope}_{grouping}",
            base,
            by_characteristic(keys, ["sex", "locality", "imd_quintile", "ethnicity"], DEATH_MEASURES),
        )
        add(f"deaths_by_age_{scope}_{grouping}", base, by_age(keys, "count(*)"))
        add(f"share_of_deaths_{scope}_{grouping}", base, share(keys[0 if grouping == "clinical" else 1], "deaths"))

add(
    "deaths_yll_by_area_by_record",
    DEATHS
    + f""", base AS (
  SELECT c.clinical_subgroup, c.clinical_group, {area_name("d.residence_la_code")} AS local_authority,
    CASE WHEN d.age < 75 THEN 74.5 - d.age WHEN d.age >= 75 THEN 0 END AS yll
  FROM (SELECT DISTINCT record_id, age, residence_la_code, icd_subgroup, cvd_group FROM coded) d
  JOIN clinical c ON d.icd_subgroup = c.code WHERE clinical_subgroup <> 'Not CVD')""",
    by_area(GROUPINGS["clinical"], DEATH_MEASURES),
)
add("deaths_yll_weighted_by_area", WEIGHTED, by_area(GROUPINGS["icd10"], WEIGHTED_MEASURES))
add(
    "deaths_yll_weighted_by_characteristic",
    WEIGHTED,
    by_characteristic(GROUPINGS["icd10"], ["sex", "locality", "imd_quintile"], WEIGHTED_MEASURES),
)
add("deaths_weighted_by_age", WEIGHTED, by_age(("cvd_group",), "sum(deaths)"))
add("deaths_weighted_clinical_by_area", WEIGHTED, by_area(GROUPINGS["clinical"], WEIGHTED_MEASURES))
add("share_of_deaths_weighted", WEIGHTED, share("cvd_group", "deaths", "sum(deaths)"))
add(
    "yearly_yll_by_sex",
    deaths("primary", "icd10"),
    f"SELECT sex, age_group, {r6(NULL_SUM.format('yll') + ' / 10.0::DOUBLE')} AS yll FROM base GROUP BY 1, 2",
)
add(
    "max_group_total_deaths",
    deaths("primary", "clinical"),
    f"""SELECT {r6("max(total)")} AS max_total FROM (
  SELECT clinical_subgroup, clinical_group, sum(deaths) AS total FROM (
    SELECT clinical_subgroup, clinical_group, sex, count(*) / 10.0::DOUBLE AS deaths FROM base GROUP BY 1, 2, 3)
  GROUP BY 1, 2)""",
)

# --- admissions ---------------------------------------------------------------------------------------------------------

HOSP_MEASURES = f"{r6('count(*) / 6.0::DOUBLE')} AS hospitalisations"


def hosp(grouping: str) -> str:
    drop = " WHERE clinical_subgroup <> 'Not CVD'" if grouping == "clinical" else ""
    return ADMISSIONS + f", base AS (SELECT * FROM admissions{drop})"


def both(grouping: str) -> str:
    """Death base and admission base under the names `base` and `hosp_base`."""
    drop = " WHERE clinical_subgroup <> 'Not CVD'" if grouping == "clinical" else ""
    shapes = deaths("primary", grouping)
    tail = ADMISSIONS[ADMISSIONS.index(", admissions AS (") :]
    return shapes + tail + f", hosp_base AS (SELECT * FROM admissions{drop})"


for grouping, keys in GROUPINGS.items():
    key = keys[0 if grouping == "clinical" else 1]
    add(f"hosp_by_area_{grouping}", hosp(grouping), by_area(keys, HOSP_MEASURES))
    add(
        f"hosp_by_characteristic_{grouping}",
        hosp(grouping),
        by_characteristic(keys, ["locality", "imd_quintile", "age_group", "gender", "ethnicity"], HOSP_MEASURES),
    )
    add(
        f"deaths_vs_hosp_long_{grouping}",
        both(grouping)
        + f""", joined AS (SELECT h.*, d.deaths, d.total_deaths, coalesce(d.percentage_deaths, 0) AS percentage_deaths
  FROM ({share(key, "hospitalisations", table="hosp_base")}) h
  LEFT JOIN ({share(key, "deaths")}) d ON h.{key} IS NOT DISTINCT FROM d.{key})""",
        "\nUNION ALL\n".join(
            f"""SELECT {key}, hospitalisations, total_hospitalisations, deaths, total_deaths, '{label}' AS outcome,
  percentage_{name} AS percentage FROM joined"""
            for label, name in (("Hospitalisations", "hospitalisations"), ("Deaths", "deaths"))
        ),
    )
    where = "WHERE local_authority IN ('Area A', 'Area B')"
    add(
        f"deaths_vs_hosp_yearly_{grouping}",
        both(grouping),
        f"""SELECT h.{keys[0]}, h.{keys[1]}, h.hospitalisations, d.deaths, d.yll
FROM (SELECT {keys[0]}, {keys[1]}, {HOSP_MEASURES} FROM hosp_base {where} GROUP BY 1, 2) h
LEFT JOIN (SELECT {keys[0]}, {keys[1]}, {DEATH_MEASURES} FROM base {where} GROUP BY 1, 2) d
  ON h.{keys[0]} IS NOT DISTINCT FROM d.{keys[0]}""",
    )
add(
    "admission_methods",
    "",
    f"""SELECT o_orderpriority AS admission_method_description, {r6("count(*) / 6.0::DOUBLE")} AS average_admissions
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)

# --- emergency admissions -----------------------------------------------------------------------------------------------

TOTALS = "count(*) AS total_admissions, count(*) FILTER (WHERE emergency) AS emergency_admissions"


def score_root(sign: str, p: str, n: str, z: str) -> str:
    """The score interval solves n (p - t)^2 = z^2 t (1 - t), that is (n + z^2) t^2 - (2 n p + z^2) t + n p^2 = 0."""
    a, b, c = f"({n}::DOUBLE + {z}^2)", f"(2 * {n}::DOUBLE * {p} + {z}^2)", f"({n}::DOUBLE * {p}^2)"
    return f"(({b} {sign} sqrt({b}^2 - 4 * {a} * {c})) / (2 * {a}))"


def limit(sign: str) -> str:
    return "100 * " + score_root(sign, "p", "total_admissions", str(Z))


def wilson(cells: str, keys: str, extra: str = "") -> str:
    return (
        f"SELECT {keys}, total_admissions, emergency_admissions, {r6('p')} AS p_hat, {r6('100 * p')} AS percentage, "
        f"{r6(limit('-'))} AS lower_ci, {r6(limit('+'))} AS upper_ci{extra} "
        f"FROM (SELECT *, emergency_admissions::DOUBLE / total_admissions AS p FROM ({cells}))"
    )


def pair(a: str, b: str, where: str = "") -> str:
    return f"SELECT {a}, {b}, {TOTALS} FROM admissions {where} GROUP BY 1, 2"


EM = ["locality", "imd_quintile", "age_group", "gender", "ethnicity", "gp_code"]
add(
    "emergency_by_characteristic",
    ADMISSIONS,
    wilson(
        by_characteristic((), EM, TOTALS, "admissions"),
        "characteristic, level",
        f", 'E38000258' AS area_code, {r6(Z + '::DOUBLE')} AS z",
    ),
)
add(
    "emergency_by_characteristic_under_75",
    ADMISSIONS + ", young AS (SELECT * FROM admissions WHERE age_category = 'Under 75')",
    wilson(by_characteristic((), EM, TOTALS, "young"), "characteristic, level"),
)
add(
    "emergency_ethnicity_age",
    ADMISSIONS,
    wilson(
        pair("ethnicity", "age_category"),
        "ethnicity, age_category",
        f", {r6('avg(100 * p) OVER (PARTITION BY age_category)')} AS group_mean",
    ),
)
for name, where in (("emergency_imd_sex", ""), ("emergency_imd_sex_under_75", "WHERE age_category = 'Under 75'")):
    add(
        name,
        ADMISSIONS,
        wilson(
            f"SELECT * FROM ({pair('imd_quintile', 'gender', where)}) WHERE gender <> 'Not known'",
            "imd_quintile, gender",
            f", {r6('avg(100 * p) OVER (PARTITION BY gender)')} AS group_mean",
        ),
    )
BROAD = ADMISSIONS + """, broad AS (
  SELECT imd_decile, regexp_replace(ethnicity, '-.*', '') AS ethnicity_broad, emergency FROM admissions),
decile_cells AS (SELECT imd_decile, ethnicity_broad, """ + TOTALS + """ FROM broad GROUP BY 1, 2)"""
add("emergency_imd_ethnicity", BROAD, wilson("SELECT * FROM decile_cells", "imd_decile, ethnicity_broad"))
add("emergency_imd_age", ADMISSIONS, wilson(pair("imd_quintile", "age_group"), "imd_quintile, age_group"))
add(
    "emergency_by_subgroup",
    ADMISSIONS,
    wilson(
        f"SELECT clinical_subgroup, {TOTALS} FROM admissions WHERE clinical_subgroup <> 'Not CVD' GROUP BY 1",
        "clinical_subgroup",
    ),
)
add(
    "emergency_mean_of_ethnicities",
    ADMISSIONS,
    f"""SELECT {r6("avg(100.0::DOUBLE * emergency_admissions / total_admissions)")} AS mean_percentage
FROM (SELECT ethnicity, {TOTALS} FROM admissions GROUP BY 1)""",
)

# --- populations and rates ----------------------------------------------------------------------------------------------

POP = "CAST(sum(observation) AS BIGINT) AS population_count"
BASES = LOOKUPS + ", " + CENSUS
add("population_by_age", BASES, f"SELECT age_band, {POP} FROM census GROUP BY 1")
add(
    "population_by_ethnicity",
    BASES,
    f"SELECT ethnicity, age_band, {POP} FROM census WHERE ethnicity IS NOT NULL GROUP BY 1, 2",
)
add(
    "population_by_sex_ethnicity",
    BASES,
    f"SELECT ethnicity, age_band, sex, {POP} FROM census WHERE ethnicity IS NOT NULL GROUP BY 1, 2, 3",
)
add("population_by_imd_decile", BASES, f"SELECT imd_decile, age_band, {POP} FROM census GROUP BY 1, 2")
add("population_by_imd_quintile", BASES, f"SELECT imd_quintile, age_band, {POP} FROM census GROUP BY 1, 2")


def events(outcome: str) -> str:
    """Event rows with band, sex, ethnicity (null when unknown) and deprivation."""
    if outcome == "admissions":
        sex, source, years = "CASE person_id % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END", "person", 6
    else:
        sex, years = "CASE WHEN sex = 1 THEN 'Male' ELSE 'Female' END", 10
        source = "(SELECT * FROM register WHERE regexp_matches(s_underlying_cod_icd10, '^I'))"
    start = PERSON if outcome == "admissions" else REGISTER
    return (
        f"{start}, {LOOKUPS}, {CENSUS}, {STDPOP}, events AS (SELECT {age_band('age')} AS age_band, {sex} AS sex, "
        f"label AS ethnicity, imd_decile, imd_quintile, {years}.0::DOUBLE AS years FROM {source} s "
        f"LEFT JOIN coding ON s.ethnic_code = code LEFT JOIN lsoa_lookup ON s.lsoa = 'L' || no)"
    )


def strata(keys: list[str], event_filter: str = "", census_filter: str = "", fill: bool = True) -> str:
    """Counts full-joined to populations, the way the two grouped tables are joined in the study."""
    cols = ", ".join(keys)
    on = " AND ".join(f"e.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    out = ", ".join(f"coalesce(e.{k}, c.{k}) AS {k}" for k in keys)
    n = "coalesce(e.n, 0)" if fill else "e.n"
    return (
        f"SELECT {out}, {n} AS n, c.pop FROM (SELECT {cols}, count(*) / any_value(years) AS n FROM events "
        f"{event_filter} GROUP BY {cols}) e FULL JOIN (SELECT {cols}, sum(observation) AS pop FROM census "
        f"{census_filter} GROUP BY {cols}) c ON {on}"
    )


def rate(cells: str, keys: list[str], counted: str = "") -> str:
    lead = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {lead}{r6("o")} AS total_count, CAST(people AS BIGINT) AS total_pop,
  CASE WHEN shown THEN {r6("v")} END AS value,
  CASE WHEN shown THEN round(v + 100000 * sqrt(s / o) * (o * (1 - 1 / (9 * o) - {Z} / (3 * sqrt(o)))^3 - o), 6) END
    AS lowercl,
  CASE WHEN shown THEN round(v + 100000 * sqrt(s / o) * ((o + 1) * (1 - 1 / (9 * (o + 1))
    + {Z} / (3 * sqrt(o + 1)))^3 - o), 6) END AS uppercl,
  '95%' AS confidence,
  CASE WHEN o < 10 THEN 'dsr NA for total count < 10' WHEN empty THEN 'dsr NA for zero population'
    ELSE 'dsr per 100000' END AS statistic, 'Dobson' AS method
FROM (SELECT *, o >= 10 AND NOT empty AS shown FROM (SELECT {lead}sum(n) FILTER (WHERE ok) AS o,
    sum(pop) FILTER (WHERE ok) AS people, coalesce(bool_or(pop = 0) FILTER (WHERE ok), FALSE) AS empty,
    100000 * sum(w * n / nullif(pop, 0)) FILTER (WHERE ok) / sum(w) FILTER (WHERE ok) AS v,
    sum(w * w * n / nullif(pop * pop, 0)) FILTER (WHERE ok) / (sum(w) FILTER (WHERE ok) * sum(w) FILTER (WHERE ok)) AS s
  FROM (SELECT cells.*, w::DOUBLE AS w, w IS NOT NULL AND pop IS NOT NULL{counted} AS ok
    FROM (SELECT * REPLACE (pop::DOUBLE AS pop, n::DOUBLE AS n) FROM ({cells})) cells
    LEFT JOIN stdpop USING (age_band)) {group}))"""


SPLIT = """SELECT * REPLACE (CASE regexp_replace(ethnicity, '^.*?-', '') WHEN ' British' THEN ' White British'
    ELSE regexp_replace(ethnicity, '^.*?-', '') END AS ethnicity), regexp_replace(ethnicity, '-.*', '') AS ethnicity_broad
  FROM ({0})"""
KNOWN = "WHERE ethnicity IS NOT NULL"


def merged(cells: str, keys: str, other: bool) -> str:
    extra = " WHEN 'Other Ethnic Groups ' THEN ' Other Ethnic Groups'" if other else ""
    return (
        f"SELECT {keys}, age_band, sum(n) AS n, CASE WHEN count(pop) = count(*) THEN sum(pop) END AS pop FROM ("
        f"SELECT * REPLACE (CASE ethnicity_broad WHEN 'Mixed ' THEN ' Mixed'{extra} ELSE ethnicity END AS ethnicity) "
        f"FROM ({cells})) GROUP BY {keys}, age_band"
    )


for outcome in ("admissions", "deaths"):
    shapes = events(outcome)
    add(f"dsr_population_{outcome}", shapes, rate(strata(["age_band"]), []))
    by_ethnicity = SPLIT.format(strata(["ethnicity", "age_band"], KNOWN, KNOWN))
    if outcome == "deaths":
        by_ethnicity = merged(by_ethnicity, "ethnicity, ethnicity_broad", True)
    add(f"dsr_ethnicity_{outcome}", shapes, rate(by_ethnicity, ["ethnicity", "ethnicity_broad"]))
    known = (
        f"SELECT coalesce(e.age_band, c.age_band) AS age_band, e.n, c.pop FROM (SELECT age_band, sum(n) AS n FROM "
        f"({strata(['ethnicity', 'age_band'], KNOWN, KNOWN)}) GROUP BY 1) e FULL JOIN (SELECT age_band, "
        f"sum(observation) AS pop FROM census GROUP BY 1) c ON e.age_band IS NOT DISTINCT FROM c.age_band"
    )
    add(f"dsr_known_ethnicity_{outcome}", shapes, rate(known, []))
    by_sex = SPLIT.format(strata(["ethnicity", "sex", "age_band"], KNOWN + " AND sex IS NOT NULL", KNOWN))
    if outcome == "admissions":
        cells = merged(by_sex, "ethnicity, ethnicity_broad, sex", False)
        add(f"dsr_sex_ethnicity_{outcome}", shapes, rate(cells, ["ethnicity", "ethnicity_broad", "sex"]))
    else:
        cells = (
            "SELECT ethnicity_broad, sex, age_band, sum(n) AS n, CASE WHEN count(pop) = count(*) THEN sum(pop) END "
            f"AS pop FROM ({by_sex}) GROUP BY 1, 2, 3"
        )
        add(f"dsr_sex_ethnicity_{outcome}", shapes, rate(cells, ["ethnicity_broad", "sex"]))
    for level in ("imd_decile", "imd_quintile"):
        add(f"dsr_{level}_{outcome}", shapes, rate(strata([level, "age_band"]), [level]))

THIN = """, thin AS (
  SELECT * REPLACE (CASE WHEN imd_decile = 3 AND age_band = '20-24' THEN 0 ELSE observation END AS observation)
  FROM census WHERE NOT coalesce(imd_decile = 2 AND age_band IN ('10-14', '15-19'), FALSE))"""
add(
    "dsr_zero_population",
    events("admissions") + THIN,
    rate(
        strata(["imd_decile", "age_band"], fill=False).replace("FROM census", "FROM thin"),
        ["imd_decile"],
        " AND n IS NOT NULL",
    ),
)
add(
    "dsr_input_gaps",
    events("admissions"),
    f"""SELECT imd_quintile, count(*) FILTER (WHERE age_band IS NULL) AS no_band,
  count(*) FILTER (WHERE pop IS NULL) AS no_population, count(*) FILTER (WHERE pop = 0) AS zero_population
FROM ({strata(["imd_quintile", "age_band"])}) GROUP BY 1""",
)

# --- matrix -------------------------------------------------------------------------------------------------------------

MATRIX = BROAD + """, cells AS (
  SELECT CAST(floor(floor(imd_decile + 1) / 2) AS INTEGER) AS imd_quintile,
    CASE ethnicity_broad WHEN 'Asian or Asian British ' THEN 'Asian' WHEN 'Black or Black British ' THEN 'Black'
      WHEN 'Other Ethnic Groups ' THEN 'Other' ELSE ethnicity_broad END AS ethnicity,
    CAST(sum(total_admissions) AS BIGINT) AS total_admissions,
    CAST(sum(emergency_admissions) AS BIGINT) AS emergency_admissions
  FROM decile_cells WHERE imd_decile IS NOT NULL AND ethnicity_broad IS NOT NULL GROUP BY 1, 2)"""
add(
    "matrix_long",
    MATRIX,
    f"SELECT *, {r6('100.0::DOUBLE * emergency_admissions / total_admissions')} AS percentage FROM cells",
)
add(
    "matrix_wide_percentage",
    MATRIX,
    "SELECT imd_quintile, "
    + ", ".join(
        f"""round(max(CASE WHEN ethnicity = '{e}' THEN 100.0::DOUBLE * emergency_admissions / total_admissions END), 6)
  AS "{e}\""""
        for e in ["Asian", "Black", "Mixed ", "Other", "Unknown", "White "]
    )
    + " FROM cells GROUP BY 1",
)
for axis, name in (("ethnicity", "matrix_margin_ethnicity"), ("imd_quintile", "matrix_margin_imd")):
    add(
        name,
        MATRIX,
        f"""SELECT {axis}, CAST(n AS BIGINT) AS total_admissions, round_even(100 * p, 1) AS percentage,
  round_even(50 * ({score_root("+", "p", "n", "1.64485")} - {score_root("-", "p", "n", "1.64485")}), 1) AS half_width
FROM (SELECT {axis}, sum(total_admissions)::DOUBLE AS n, sum(emergency_admissions)::DOUBLE / sum(total_admissions) AS p
  FROM cells GROUP BY 1)""",
    )

# --- ordering, totals, checks -------------------------------------------------------------------------------------------

add(
    "rank_within_facet",
    deaths("primary", "icd10"),
    f"""SELECT ethnicity, sex, {r6("deaths")} AS deaths,
  CAST(row_number() OVER (PARTITION BY sex ORDER BY deaths, ethnicity) AS INTEGER) AS position
FROM (SELECT ethnicity, sex, count(*) / 10.0::DOUBLE AS deaths FROM base GROUP BY 1, 2)""",
)
add(
    "rank_over_all",
    deaths("primary", "icd10"),
    f"""SELECT ethnicity, sex, {r6("deaths")} AS deaths,
  row_number() OVER (ORDER BY deaths DESC, ethnicity, sex NULLS FIRST) AS position
FROM (SELECT ethnicity, sex, count(*) / 10.0::DOUBLE AS deaths FROM base GROUP BY 1, 2)""",
)
add(
    "ethnicity_levels",
    REGISTER + ", " + LOOKUPS,
    """SELECT ethnicity, dense_rank() OVER (ORDER BY ethnicity) AS by_name,
  dense_rank() OVER (ORDER BY mean_age DESC NULLS LAST, ethnicity) AS by_age, n
FROM (SELECT coalesce(label, 'Unknown') AS ethnicity, avg(age) AS mean_age, count(*) AS n
  FROM register LEFT JOIN coding ON ethnic_code = code GROUP BY 1)""",
)
add(
    "full_join_repeated_keys",
    ADMISSIONS + ", " + CENSUS,
    """SELECT coalesce(a.lsoa, p.lsoa) AS lsoa, gender, n, sex, age_code, population_count
FROM (SELECT lsoa, gender, count(*) AS n FROM (SELECT lsoa, CASE person_id % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female'
    ELSE 'Not known' END AS gender FROM person) WHERE coalesce(lsoa, '') <> 'L03' GROUP BY 1, 2) a
FULL JOIN (SELECT CASE WHEN no <> '07' THEN 'L' || no END AS lsoa, sex, age_code, CAST(sum(observation) AS BIGINT)
    AS population_count FROM census GROUP BY 1, 2, 3) p ON a.lsoa IS NOT DISTINCT FROM p.lsoa""",
)
add(
    "stored_partitions_replaced",
    REGISTER,
    """SELECT year, sex, count(*) AS n, CAST(sum(deaths_weight + CASE year WHEN 1996 THEN 10 ELSE 0 END) AS BIGINT)
  AS deaths FROM (SELECT *, CAST(year(reg_date) AS INTEGER) AS year FROM register)
WHERE year BETWEEN 1995 AND 1997 AND (year <> 1996 OR sex <> 0) GROUP BY 1, 2""",
)
add(
    "csv_round_trip",
    REGISTER,
    f"""SELECT age, count(*) AS n, count(patient_id) AS persons, {", ".join(f"count({c}) AS {c}" for c in CAUSES[:4])},
  CAST(min(reg_date) AS VARCHAR) AS first_date, max(record_id) AS last_record FROM register GROUP BY 1""",
)
add(
    "matrix_all_margins",
    ADMISSIONS,
    f"""SELECT imd_quintile, gender, CAST(margin AS INTEGER) AS margin, CAST(total AS BIGINT) AS total_admissions,
  CAST(hits AS BIGINT) AS emergency_admissions, round_even(100 * p, 1) AS percentage,
  round_even(50 * ({score_root("+", "p", "n", "1.64485")} - {score_root("-", "p", "n", "1.64485")}), 1) AS half_width
FROM (SELECT *, total::DOUBLE AS n, hits::DOUBLE / total AS p FROM (
  SELECT imd_quintile, gender, grouping(imd_quintile, gender) AS margin, count(*) AS total,
    count(*) FILTER (WHERE emergency) AS hits FROM admissions
  GROUP BY GROUPING SETS ((imd_quintile, gender), (imd_quintile), (gender), ())))""",
)
add(
    "grand_total",
    ADMISSIONS,
    """SELECT gp_code, n, CAST(sum(n) OVER () AS BIGINT) AS total
FROM (SELECT gp_code, count(*) AS n FROM admissions GROUP BY 1)""",
)
add(
    "counts_by_characteristic",
    ADMISSIONS,
    by_characteristic((), ["gender", "imd_quintile", "locality"], "count(*) AS n", "admissions"),
)
add(
    "quality_nulls",
    ADMISSIONS,
    "\nUNION ALL\n".join(
        f"""SELECT count(*) AS "rows", '{c}' AS column_name, count(*) - count({c}) AS null_rows,
  count({c}) < count(*) AS any_null FROM admissions"""
        for c in ["locality", "clinical_subgroup", "admission_group", "cvd_group", "gp_code"]
    ),
)
add(
    "quality_crosstab",
    ADMISSIONS,
    "SELECT admission_method_description, admission_group, count(*) AS n FROM admissions GROUP BY 1, 2",
)
add("quality_flag_counts", ADMISSIONS, "SELECT emergency, count(*) AS n FROM admissions GROUP BY 1")
