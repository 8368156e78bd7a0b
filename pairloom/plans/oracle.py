"""The named queries as DuckDB SQL, written independently of the Spark plans.

Similarity joins compare every pair here; the Spark side must find the same pairs without doing so.
"""

from __future__ import annotations

from itertools import combinations

from pairloom.functions.stem import ADJECTIVAL, DERIVED, DROPPED, SPECIAL

ORACLE: dict[str, str] = {}

WS = r"[\s\x1c-\x1f\x85\p{Z}]+"
PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\]^_`{|}~]"""
SOURCES = ", ".join(f"'src{i}'" for i in range(10))
BRANDS = ", ".join(f"'Brand#{i}'" for i in range(1, 14))
ORDER = ("author_names", "paper_title", "year", "publication_venue")

# ------------------------------------------------------------------------------ expressions


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_distinct({words(f'lower({x})')})"


def chars(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '(?s).'))"


def initials(x: str) -> str:
    return f"array_to_string(list_transform({words(x)}, lambda w: w[1:1]), '')"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda place: substring({x}, place, {n}))"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"coalesce({common} / nullif(len({a}) + len({b}) - {common}, 0), 0.0)"


def dice(a: str, b: str) -> str:
    return f"coalesce(2 * len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}), 0), 0.0)"


def edit(a: str, b: str) -> str:
    """Edit distance of two small token sets, spelt with ASCII letters."""

    def spell(s: str) -> str:
        alphabet = f"list_sort(list_distinct(list_concat({a}, {b})))"
        return (
            f"array_to_string(list_transform(list_sort({s}), "
            f"lambda t: chr((list_position({alphabet}, t) + 64)::int)), '')"
        )

    return f"coalesce(1 - levenshtein({spell(a)}, {spell(b)}) / nullif(len({a}) + len({b}), 0), 0.0)"


def upper(x: str) -> str:
    return f"replace(upper({x}), 'ẞ', 'SS')"


def title(x: str) -> str:
    runs = rf"regexp_extract_all(lower({x}), '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda r: {upper('r[1:1]')} || r[2:]), '')"


def alnum(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"


AUGMENT = {
    "identity": lambda x: x,
    "upper": upper,
    "lower": lambda x: f"lower({x})",
    "title": title,
    "alphanumerical": alnum,
    "reverse": lambda x: f"reverse({x})",
}


def augment(x: str, names) -> str:
    for name in names:
        x = AUGMENT[name](x)
    return x


def language(x: str) -> str:
    return f"case when contains({x}, 'en') then 'en' else 'other' end"


def sigmod(x: str) -> str:
    return f"case when contains({x}, 'sigmod') then 'sigmod' else 'vldb' end"


def normalise(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}', ' ', 'g'))"


def year_label(x: str) -> str:
    return f"case when {x} >= 1995 and {x} < 2005 then {x}::varchar end"


# ----------------------------------------------------------------------------------- tables

NAMES = r"regexp_extract_all(text, '\p{Lu}\p{L}*')"
DOCS = f"""docs AS (
  SELECT doc_id::varchar AS "index", text AS paper_title,
    array_to_string(list_filter({NAMES}, lambda x, i: list_position({NAMES}, x) = i), ' ') AS author_names,
    (length(bin(n_chars)) + 1990)::int AS year, lang AS publication_venue,
    CASE WHEN source IN ({SOURCES}) THEN 'a' ELSE 'b' END AS side
  FROM documents)"""
TITLES = f"""titles AS (
  SELECT doc_id::varchar AS "index", text AS paper_title,
    CASE WHEN source IN ({SOURCES}) THEN 'a' ELSE 'b' END AS side
  FROM documents)"""
PARTS = f"""parts AS (
  SELECT p_partkey::varchar AS "index", p_name AS paper_title, p_type AS author_names,
    (p_size + 1990)::int AS year, p_brand AS publication_venue,
    CASE WHEN p_brand IN ({BRANDS}) THEN 'a' ELSE 'b' END AS side
  FROM part)"""
PAGES = r"""page_rows AS (
  SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS paper_title,
    replace(regexp_extract(url, '^https?://([^/:]+)', 1), '.', ' ') AS host,
    regexp_extract(url, '/([0-9]+)(?:$|[?#])', 1) AS year,
    nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS publication_venue
  FROM pages),
raw AS (
  SELECT paper_title, CASE WHEN NOT starts_with(host, 'www ') THEN host END AS author_names,
    year, publication_venue,
    CASE WHEN NOT starts_with(host, 'm ') THEN page_id::varchar END AS "index"
  FROM page_rows),
parsed AS (SELECT * REPLACE (CASE WHEN isfinite(try_cast(year AS double)) THEN try_cast(year AS double) END AS year) FROM raw)"""

# --------------------------------------------------------------------------------- cleaning

ORACLE["clean_text"] = f"""WITH {DOCS} SELECT {normalise('"index"')} AS "index",
  {normalise('paper_title')} AS paper_title, {normalise('author_names')} AS author_names, year,
  {normalise('publication_venue')} AS publication_venue FROM docs"""


def _titles(expression: str) -> str:
    return f'SELECT doc_id::varchar AS "index", {expression} AS paper_title FROM documents'


ORACLE["strip_punct"] = _titles(f"regexp_replace(text, '{PUNCT}', '', 'g')")
for _short, _name in (
    ("lower", "lower"), ("upper", "upper"), ("reverse", "reverse"), ("title", "title"),
    ("alnum", "alphanumerical"),
):
    ORACLE[f"augment_{_short}"] = _titles(AUGMENT[_name]("text"))
PAIRED = list(combinations(("upper", "lower", "title", "alphanumerical", "reverse"), 2))
ORACLE["augment_compose"] = " UNION ALL ".join(
    f"""SELECT doc_id::varchar AS "index", '{"_".join(names)}' AS augmentations,
    md5({augment('text', names)}) AS digest FROM documents"""
    for names in PAIRED
)
ORACLE["parse_years"] = f"WITH {PAGES} SELECT paper_title, year FROM parsed WHERE year IS NOT NULL"
_FILL = {
    "mean": "(SELECT avg(year) FROM parsed)",
    "median": "(SELECT median(year) FROM parsed)",
    "mode": """(SELECT year FROM parsed WHERE year IS NOT NULL
      GROUP BY year ORDER BY count(*) DESC, year LIMIT 1)""",
}
for _method, _value in _FILL.items():
    ORACLE[f"fill_year_{_method}"] = (
        f"WITH {PAGES} SELECT paper_title, round(coalesce(year, {_value}), 6) AS year FROM parsed"
    )
ORACLE["filter_range_venue"] = f"""WITH {PAGES} SELECT * FROM parsed
  WHERE year BETWEEN 10 AND 500 AND regexp_matches(publication_venue, '(?i)EN|DE')"""
ORACLE["fill_defaults"] = f"""WITH {PAGES} SELECT * REPLACE (
  coalesce(paper_title, 'Untitled') AS paper_title, coalesce(author_names, 'unamed') AS author_names)
  FROM raw"""


def _named(table: str, **shown: str) -> str:
    """Rows of ``table`` with ids for those that lack one: md5 of the record's md5 and its occurrence number."""
    key = " || ".join(
        f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || length({shown.get(c, c)}) || ':' || {shown.get(c, c)} END"
        for c in ("paper_title", "author_names", "year", "publication_venue")
    )
    return f"""SELECT * EXCLUDE (k, seen) REPLACE (coalesce("index", md5(k || '#' || seen)) AS "index") FROM (
      SELECT *, row_number() OVER (PARTITION BY k, "index" IS NULL) AS seen FROM (
        SELECT *, md5({key}) AS k FROM {table}))"""


ORACLE["surrogate_ids"] = f"WITH {PAGES} {_named('raw')}"
ORACLE["dedupe_records"] = f"""WITH {DOCS}
  SELECT min("index") AS "index", paper_title, author_names, year, publication_venue FROM docs
  GROUP BY paper_title, author_names, year, publication_venue"""
ORACLE["integer_years"] = f"""WITH {PAGES} SELECT * REPLACE (
  trunc(coalesce(year, {_FILL['mean']}))::int AS year) FROM parsed"""
ORACLE["parse_citations"] = rf"""WITH {DOCS} SELECT * EXCLUDE (side) REPLACE (
  trim(regexp_replace(paper_title, '\s+', ' ', 'g')) AS paper_title, year::varchar AS year) FROM docs"""


def _prepared() -> str:
    def cleaned(c):
        return normalise(f"regexp_replace({c}, '{PUNCT}', '', 'g')")

    return f"""WITH {PAGES},
      filled AS (SELECT * REPLACE (coalesce(year, {_FILL['mean']}) AS year) FROM parsed),
      kept AS (SELECT * REPLACE (coalesce(paper_title, 'Untitled') AS paper_title,
          coalesce(author_names, 'unamed') AS author_names) FROM filled
        WHERE year BETWEEN 10 AND 500 AND regexp_matches(publication_venue, '(?i)EN|DE')),
      named AS ({_named('kept', year="CASE WHEN year = trunc(year) THEN year::bigint::varchar || '.0' ELSE year::varchar END")})
      SELECT {cleaned('paper_title')} AS paper_title, {normalise('author_names')} AS author_names,
        trunc(year)::int AS year, {cleaned('publication_venue')} AS publication_venue,
        {normalise('"index"')} AS "index" FROM named"""


ORACLE["prepare_records"] = _prepared()



def _choices(endings) -> str:
    return "|".join(endings)


def _mapped(table: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _stem_steps(vocabulary: str) -> str:
    """CTEs from the distinct words ``vocabulary(t)`` to ``stems(t, stem)``, one step at a time."""
    short = "regexp_matches(stem, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"
    region = "length(regexp_extract({0}, '^.*?[aeiouy][^aeiouy]'))"
    steps = []

    def step(name: str, source: str, word: str, done: str = "done") -> None:
        steps.append(f"""{name} AS MATERIALIZED (SELECT t, r1, r2, {done} AS done,
          CASE WHEN done THEN w ELSE {word} END AS w FROM {source})""")

    def suffix(name: str, source: str, endings, replaced: str, allowed: str) -> None:
        steps.append(f"""{name}_e AS (SELECT *, regexp_extract(w, '({_choices(endings)})$', 1) AS e
          FROM {source}),
        {name}_p AS (SELECT *, left(w, (length(w) - length(e))::int) AS stem FROM {name}_e)""")
        step(name, f"{name}_p", f"CASE WHEN e <> '' AND {allowed} THEN stem || {replaced} ELSE w END")

    steps.append(f"""marked AS (SELECT t, regexp_replace(regexp_replace(regexp_replace(
        translate(t, '’‘‛', repeat(chr(39), 3)), '^\\x27', ''), '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w
        FROM {vocabulary}),
      one AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)')
          THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
          ELSE coalesce(nullif({region.format('w')}, 0), length(w)) END AS r1 FROM marked),
      two AS (SELECT *, substring(w, r1 + 1) AS rest, {_mapped(SPECIAL, 't')} AS fixed FROM one),
      begun AS MATERIALIZED (SELECT t, r1,
          r1 + coalesce(nullif({region.format('rest')}, 0), length(rest)) AS r2,
          length(t) <= 2 OR fixed IS NOT NULL AS done,
          CASE WHEN length(t) <= 2 THEN t ELSE coalesce(fixed, w) END AS w FROM two)""")
    step("possessive", "begun", "regexp_replace(w, '(\\x27s\\x27|\\x27s|\\x27)$', '')")
    step("plural", "possessive", """CASE
        WHEN w LIKE '%sses' THEN left(w, -2)
        WHEN regexp_matches(w, '(ied|ies)$') THEN left(w, CASE WHEN length(w) > 4 THEN -2 ELSE -1 END)
        WHEN regexp_matches(w, '(us|ss)$') THEN w
        WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, -1) ELSE w END""")
    step("kept", "plural", "w", """done OR w IN ('inning', 'outing', 'canning', 'herring', 'earring',
        'proceed', 'exceed', 'succeed')""")
    steps.append("""past_e AS (SELECT *, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 1) AS e FROM kept),
      past_p AS (SELECT *, left(w, (length(w) - length(e))::int) AS stem FROM past_e)""")
    step("past", "past_p", f"""CASE WHEN e = '' THEN w
        WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(stem) >= r1 THEN stem || 'ee' ELSE w END
        WHEN NOT regexp_matches(stem, '[aeiouy]') THEN w
        WHEN regexp_matches(stem, '(at|bl|iz)$') THEN stem || 'e'
        WHEN regexp_matches(stem, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(stem, -1)
        WHEN length(stem) <= r1 AND {short} THEN stem || 'e' ELSE stem END""")
    step("final_y", "past", "regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i')")
    suffix("derived", "final_y", DERIVED, _mapped(DERIVED, "e"), """length(stem) >= r1
        AND (e <> 'ogi' OR w LIKE '%logi') AND (e <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$'))""")
    suffix("adjectival", "derived", ADJECTIVAL, _mapped(ADJECTIVAL, "e"),
           "length(stem) >= r1 AND (e <> 'ative' OR length(stem) >= r2)")
    suffix("dropped", "adjectival", DROPPED, "''",
           "length(stem) >= r2 AND (e <> 'ion' OR regexp_matches(w, '[st]ion$'))")
    steps.append("last_p AS (SELECT *, left(w, -1) AS stem, length(w) - 1 AS n FROM dropped)")
    step("trimmed", "last_p", f"""CASE
        WHEN w LIKE '%e' AND (n >= r2 OR (n >= r1 AND NOT {short})) THEN stem
        WHEN w LIKE '%ll' AND n >= r2 THEN stem ELSE w END""")
    steps.append("stems AS (SELECT t, replace(w, 'Y', 'y') AS stem FROM trimmed)")
    return ", ".join(steps)


_CLEANED = normalise(f"regexp_replace(text, '{PUNCT}', '', 'g')")
ORACLE["stem_titles"] = f"""WITH cleaned AS (SELECT doc_id, {words(_CLEANED)} AS ws FROM documents),
  places AS MATERIALIZED (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS place FROM cleaned),
  vocabulary AS (SELECT DISTINCT t FROM places), {_stem_steps('vocabulary')},
  joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY place) AS stemmed
    FROM places JOIN stems USING (t) GROUP BY doc_id)
  SELECT doc_id::varchar AS "index", coalesce(stemmed, '') AS paper_title
  FROM documents LEFT JOIN joined USING (doc_id)"""


def _prepared_stemmed() -> str:
    places = " UNION ALL ".join(
        f"SELECT \"index\", '{c}' AS field, unnest(ws) AS t, generate_subscripts(ws, 1) AS place "
        f"FROM (SELECT \"index\", {words(c)} AS ws FROM prepared)"
        for c in ("paper_title", "publication_venue")
    )

    def field(c: str) -> str:
        return f"""coalesce((SELECT stemmed FROM joined j
          WHERE j."index" = prepared."index" AND j.field = '{c}'), '') AS {c}"""

    return f"""WITH prepared AS MATERIALIZED ({_prepared()}), places AS MATERIALIZED ({places}),
      vocabulary AS (SELECT DISTINCT t FROM places), {_stem_steps('vocabulary')},
      joined AS MATERIALIZED (SELECT "index", field, string_agg(stem, ' ' ORDER BY place) AS stemmed
        FROM places JOIN stems USING (t) GROUP BY ALL)
      SELECT {field('paper_title')}, author_names, year, {field('publication_venue')}, "index"
      FROM prepared"""


ORACLE["prepare_records_stemmed"] = _prepared_stemmed()

# -------------------------------------------------------------------------------- profiling

_MOMENTS = """years AS (SELECT (length(bin(n_chars)) + 1990)::double AS x FROM documents),
  centred AS (SELECT x - (SELECT avg(x) FROM years) AS d FROM years),
  m AS (SELECT avg(d^3) / pow(avg(d^2), 1.5) AS s, avg(d^4) / pow(avg(d^2), 2) - 3 AS k FROM centred)"""
ORACLE["year_moments"] = (
    f"WITH {_MOMENTS} SELECT round(s, 6) AS skewness, round(k, 6) AS kurtosis FROM m"
)
ORACLE["year_shape"] = f"""WITH {_MOMENTS} SELECT
  CASE WHEN s < 0.1 AND k BETWEEN 2.8 AND 3.2 THEN 'normal' WHEN s > 0.1 THEN 'right'
    WHEN s < -0.1 THEN 'left' END AS lean,
  CASE WHEN k > 3.2 THEN 'peaked' WHEN k < 2.8 THEN 'flat' END AS tails FROM m"""
ORACLE["year_histogram"] = """WITH years AS (SELECT length(bin(n_chars)) + 1990 AS x FROM documents),
  ends AS (SELECT min(x)::double AS low, max(x)::double AS high FROM years)
  SELECT least(floor(10 * (x - low) / (high - low))::int + 1, 10) AS bin, count(*) AS n
  FROM years, ends GROUP BY 1"""
ORACLE["null_profile"] = "WITH " + PAGES + " SELECT " + ", ".join(
    f'(count(*) - count("{c}"))::bigint AS "{c}"' for c in (*ORDER, "index")
) + " FROM parsed"

# --------------------------------------------------------------------------------- blocking


def initials_key(columns, venue=sigmod) -> str:
    parts = {
        "author_names": initials("author_names"),
        "paper_title": initials("paper_title"),
        "year": "year::varchar",
        "publication_venue": venue("publication_venue"),
    }
    return " || ".join(f"({parts[c]})" for c in columns)


TEXTS = ("author_names", "paper_title")
ORACLE["block_initials_hash"] = f"""WITH {DOCS}, k AS (
  SELECT {initials_key(ORDER, language)} AS blocking_key, "index" FROM docs)
  SELECT DISTINCT blocking_key, md5(blocking_key) AS value, "index" FROM k"""
ORACLE["block_initials_rows"] = f"""WITH {DOCS}, k AS (
  SELECT {initials_key(ORDER, lambda x: x)} AS blocking_key, "index" FROM docs)
  SELECT "index", blocking_key, md5(blocking_key) AS value FROM k"""
ORACLE["block_full_hash"] = f"""WITH {DOCS}
  SELECT md5({' || '.join(f'{c}::varchar' for c in ORDER)}) AS blocking_key, "index" FROM docs"""
for _n in (2, 3):
    ORACLE[f"block_initials_ngram{_n}"] = f"""WITH {DOCS}, k AS (
      SELECT {initials_key(TEXTS)} AS blocking_key, "index" FROM docs)
      SELECT md5(blocking_key) AS blocking_key,
        md5(array_to_string({grams('blocking_key', _n)}, '|')) AS value, "index" FROM k"""
    ORACLE[f"block_full_ngram{_n}"] = f"""WITH {DOCS} SELECT sha256(
        '{{"author_names":' || to_json(CASE WHEN length(author_names) < {_n} THEN '' ELSE author_names END) ||
        ',"paper_title":' || to_json(CASE WHEN length(paper_title) < {_n} THEN '' ELSE paper_title END) || '}}'
      ) AS blocking_key,
      md5(array_to_string({grams('author_names', _n)}, '|')) ||
      md5(array_to_string({grams('paper_title', _n)}, '|')) AS value, "index" FROM docs"""
ORACLE["block_length"] = f"""WITH {DOCS} SELECT
  'Lengths_' || {" || '_' || ".join(f'length({c}::varchar)' for c in ORDER)} AS blocking_key,
  {', '.join(f'length({c}::varchar)::int AS length_{c}' for c in ORDER)}, "index" FROM docs"""
ORACLE["block_length_rows"] = f"""WITH {PAGES} SELECT paper_title,
  length(coalesce(author_names, 'None')) || '_' || length(coalesce(paper_title, 'None')) AS blocking_key
  FROM raw"""
ORACLE["block_year"] = f"""WITH {DOCS} SELECT DISTINCT year::varchar AS blocking_key, "index"
  FROM docs WHERE year >= 1995 AND year < 2005"""
_PUBLISHED = """published AS (
  SELECT *, year::varchar AS year_label FROM parts, (VALUES ('Brand#1'), ('Brand#2')) AS p(publisher)
  WHERE contains(publication_venue, publisher) AND year >= 1995 AND year < 2005)"""
ORACLE["block_year_publisher"] = f"""WITH {PARTS}, {_PUBLISHED}
  SELECT DISTINCT year_label || '-' || publisher AS blocking_key, year_label, publisher, "index"
  FROM published"""
ORACLE["block_year_selected"] = f"""WITH {PARTS}, {_PUBLISHED}
  SELECT DISTINCT year_label || '-' || publisher AS blocking_key, "index" FROM published
  WHERE year >= 1997 AND year < 2001"""
_YEAR_VENUE = f"{year_label('year')} || '-' || publication_venue"
ORACLE["block_year_venue"] = (
    f'WITH {DOCS} SELECT "index", {_YEAR_VENUE} AS blocking_key FROM docs'
)
ORACLE["block_two_level"] = f"""WITH {PARTS}, {_PUBLISHED} SELECT DISTINCT
  year_label || '-' || publisher AS outer_key, {initials_key(TEXTS)} AS blocking_key, "index"
  FROM published"""
ORACLE["block_sizes"] = f"""WITH {DOCS} SELECT {_YEAR_VENUE} AS blocking_key, count(*) AS records
  FROM docs GROUP BY 1"""
ORACLE["block_stats"] = f"""WITH {PARTS}, b AS (
  SELECT {initials_key(TEXTS)} AS k, count(*) AS n FROM parts GROUP BY 1)
  SELECT count(*) AS blocks, sum(n)::bigint AS records, sum(n * (n - 1) // 2)::bigint AS pairs FROM b"""

# ------------------------------------------------------------------------- equality matches


def matched(keyed: str, *on: str) -> str:
    """Rows of ``keyed`` whose key occurs on both sides."""
    key = ", ".join(on)
    return f"""SELECT DISTINCT {key}, side, "index" FROM {keyed} WHERE ({key}) IN (
      SELECT ({key}) FROM {keyed} WHERE side = 'a' INTERSECT
      SELECT ({key}) FROM {keyed} WHERE side = 'b')"""


def _match(expression: str, name: str = "value", table: str = DOCS) -> str:
    return f"""WITH {table}, k AS (SELECT {expression} AS {name}, side, "index" FROM docs)
      {matched('k', name)}"""


ORACLE["match_initials_hash"] = _match(f"md5({initials('paper_title')})")
ORACLE["match_full_hash"] = _match("md5(author_names || paper_title)")


def _match_grams(text: str, n: int, name: str) -> str:
    """Records whose lists of n-grams are equal, list against list; ``name`` only names what is found."""
    return f"""WITH {DOCS}, i AS (SELECT {text} AS key, side, "index" FROM docs),
      k AS (SELECT {name} AS value, {grams('key', n)} AS list, side, "index" FROM i)
      SELECT DISTINCT value, side, "index" FROM k WHERE list IN (
        SELECT list FROM k WHERE side = 'a' INTERSECT SELECT list FROM k WHERE side = 'b')"""


ORACLE["match_initials_ngram_exact"] = _match_grams(
    initials_key(TEXTS), 2, "md5(CASE WHEN length(key) < 2 THEN '' ELSE key END)"
)
ORACLE["match_full_ngram"] = _match_grams(
    "paper_title",
    3,
    """sha256('{"paper_title":' || to_json(CASE WHEN length(key) < 3 THEN '' ELSE key END)::varchar || '}')""",
)
ORACLE["match_length"] = _match(
    "'Lengths_' || length(author_names) || '_' || length(paper_title)", "blocking_key"
)
ORACLE["match_two_level"] = f"""WITH {DOCS}, k AS (
  SELECT year::varchar || '-' || publisher AS outer_key, md5({initials('paper_title')}) AS value,
    side, "index"
  FROM docs, (VALUES ('en'), ('de')) AS p(publisher)
  WHERE contains(publication_venue, publisher) AND year >= 1995 AND year < 2005)
  {matched('k', 'outer_key', 'value')}"""
ORACLE["match_counts"] = f"""WITH {PARTS} SELECT md5(paper_title) AS value,
  count(*) FILTER (side = 'a') AS n1, count(*) FILTER (side = 'b') AS n2 FROM parts GROUP BY 1
  HAVING n1 > 0 AND n2 > 0"""

# ----------------------------------------------------------------------- similarity matches


def classes(table: str, *columns: str) -> str:
    key = ", ".join(columns)
    return f"""classes AS (SELECT {key}, min("index") FILTER (side = 'a') AS rep1,
      min("index") FILTER (side = 'b') AS rep2, count(*) FILTER (side = 'a') AS n1,
      count(*) FILTER (side = 'b') AS n2 FROM {table} GROUP BY ALL)"""


def numbered(table: str, columns: tuple[str, ...], views: dict[str, str]) -> str:
    """CTE ``sets``: the classes with an id and one token set per entry of ``views``."""
    made = ", ".join(f"{view} AS {name}" for name, view in views.items())
    return f"""{classes(table, *columns)},
      sets AS MATERIALIZED (SELECT row_number() OVER () AS id, *, {made} FROM classes)"""


def overlaps(name: str, column: str) -> str:
    """CTE with the size of the overlap of every pair of sets that share anything."""

    def unnested(count: str) -> str:
        return f"(SELECT id, unnest({column}) AS w FROM sets WHERE {count} > 0)"

    return f"""{name} AS MATERIALIZED (SELECT x.id AS i, y.id AS j, count(*) AS o
      FROM {unnested('n1')} x JOIN {unnested('n2')} y USING (w) GROUP BY ALL)"""


def title_pairs(name: str, threshold: float, score=jaccard, view=tokens, source=TITLES, table="titles"):
    """CTEs that end in ``name``: class pairs on the title. Pairs that share nothing score 0."""
    sim = {
        jaccard: "o / (len(x.s) + len(y.s) - o)",
        dice: "2 * o / (len(x.s) + len(y.s))",
        edit: edit("x.s", "y.s"),
    }[score]
    pairs = "sets x, sets y WHERE x.n1 > 0 AND y.n2 > 0"
    if score is not edit:
        pairs = "ov JOIN sets x ON x.id = i JOIN sets y ON y.id = j"
    return f"""{source}, {numbered(table, ('paper_title',), {'s': view('paper_title')})},
      {overlaps('ov', 's')},
      scored AS (SELECT x.rep1, y.rep2, x.n1, y.n2, {sim} AS sim FROM {pairs}),
      {name} AS MATERIALIZED (SELECT * FROM scored WHERE sim >= {threshold})"""


def baseline(name: str, threshold: float, score=jaccard) -> str:
    def one(c: str) -> str:
        both = f"len(x.s_{c}) + len(y.s_{c})"
        return f"2 * {c}.o / ({both})" if score is dice else f"{c}.o / ({both} - {c}.o)"

    score = " + ".join(
        [f"coalesce({one(c)}, 0.0)" for c in TEXTS]
        + [f"(x.{c} = y.{c})::int" for c in ("year", "publication_venue")]
    )
    joins = " ".join(f"LEFT JOIN ov_{c} {c} ON {c}.i = x.id AND {c}.j = y.id" for c in TEXTS)
    return f"""{name} AS MATERIALIZED (SELECT * FROM (
      SELECT x.rep1, y.rep2, x.n1, y.n2, ({score}) / 4 AS sim
      FROM sets x JOIN sets y ON x.n1 > 0 AND y.n2 > 0 {joins}) WHERE sim >= {threshold})"""


_SETS = f"""{DOCS},
  {numbered('docs', ORDER, {f's_{c}': tokens(c) for c in TEXTS})},
  {', '.join(overlaps(f'ov_{c}', f's_{c}') for c in TEXTS)}"""
_PAIR_COLUMNS = "rep1, rep2, n1, n2, round(sim, 6) AS sim"


def lower_chars(x: str) -> str:
    return chars(f"regexp_replace(lower({x}), '{WS}', '', 'g')")


for _percent, _t in ((70, 0.7), (85, 0.85)):
    ORACLE[f"baseline_jac_title_{_percent}"] = (
        f"WITH {title_pairs('p', _t)} SELECT {_PAIR_COLUMNS} FROM p"
    )
    ORACLE[f"baseline_dice_{_percent}"] = (
        f"WITH {title_pairs('p', _t, dice)} SELECT {_PAIR_COLUMNS} FROM p"
    )
    _dice_parts = title_pairs("p", _t, dice, lower_chars, PARTS, "parts")
    ORACLE[f"baseline_dice_chars_{_percent}"] = f"WITH {_dice_parts} SELECT {_PAIR_COLUMNS} FROM p"
    _edit_parts = title_pairs("p", _t, edit, tokens, PARTS, "parts")
    ORACLE[f"baseline_edit_{_percent}"] = f"WITH {_edit_parts} SELECT {_PAIR_COLUMNS} FROM p"
    ORACLE[f"baseline_jac_{_percent}"] = (
        f"WITH {_SETS}, {baseline('p', _t)} SELECT {_PAIR_COLUMNS} FROM p"
    )
    _need = 3 if _percent == 70 else 4
    _keys = " UNION ALL ".join(
        f"""SELECT '{"+".join(c)}' AS agreeing, md5({" || ".join(c)}) AS "group", side, "index" FROM d"""
        for c in combinations(ORDER, _need)
    )
    _digests = ", ".join(
        f"md5(array_to_string(list_sort({tokens(f'{c}::varchar')}), ' ')) AS {c}" for c in ORDER
    )
    ORACLE[f"baseline_exact_{_percent}"] = f"""WITH {DOCS},
      d AS (SELECT {_digests}, side, "index" FROM docs), k AS ({_keys})
      {matched('k', 'agreeing', '"group"')}"""

for _percent, _t in ((70, 0.7), (85, 0.85)):
    ORACLE[f"baseline_dice_all_{_percent}"] = (
        f"WITH {_SETS}, {baseline('p', _t, dice)} SELECT {_PAIR_COLUMNS} FROM p"
    )


def _part_pairs(score: str, threshold: float, key: tuple[str, ...], views: dict[str, str], source: str, table: str) -> str:
    """Every pair of classes of parts, scored."""
    return f"""WITH {source}, {numbered(table, key, views)}
      SELECT * REPLACE (round(sim, 6) AS sim) FROM (
        SELECT {"x.outer_key, " if "outer_key" in key else ""}x.rep1, y.rep2, x.n1, y.n2, {score} AS sim
        FROM sets x JOIN sets y ON x.n1 > 0 AND y.n2 > 0 {"AND x.outer_key = y.outer_key" if "outer_key" in key else ""})
      WHERE sim >= {threshold}"""


_both = lambda measure: " + ".join(measure(f"x.s_{c}", f"y.s_{c}") for c in TEXTS)
_same = " + ".join(f"(CASE WHEN x.{c} = y.{c} THEN 1 ELSE 0.5 END)" for c in ("year", "publication_venue"))
ORACLE["baseline_edit_all_85"] = _part_pairs(
    f"({_both(edit)} + {_same}) / 4", 0.85, ORDER, {f"s_{c}": tokens(c) for c in TEXTS}, PARTS, "parts"
)
for _n in (2, 3):
    ORACLE[f"match_full_ngram{_n}_jaccard"] = _part_pairs(
        f"({_both(jaccard)}) / 2", 0.7, TEXTS,
        {f"s_{c}": f"list_distinct({grams(c, _n)})" for c in TEXTS}, PARTS, "parts"
    )
_NESTED = f"""{PARTS}, {_PUBLISHED}, nested AS (SELECT year_label || '-' || publisher AS outer_key,
    {initials_key(TEXTS)} AS initials, side, "index" FROM published)"""
ORACLE["match_two_level_similar"] = _part_pairs(
    jaccard("x.s", "y.s"), 0.7, ("outer_key", "initials"), {"s": f"list_distinct({grams('initials', 2)})"}, _NESTED, "nested"
)
ORACLE["class_members"] = f"""WITH {TITLES}
  SELECT side, min("index") OVER (PARTITION BY side, paper_title) AS rep, "index" FROM titles"""


_INITIAL_GRAMS = f"""{TITLES}, i AS (SELECT *, {initials('paper_title')} AS i FROM titles),
  g AS (SELECT "index", side, array_to_string({grams('i', 3)}, ' ') AS paper_title FROM i)"""
ORACLE["match_initials_ngram_jaccard"] = (
    f"WITH {title_pairs('p', 0.7, jaccard, tokens, _INITIAL_GRAMS, 'g')} SELECT {_PAIR_COLUMNS} FROM p"
)
_BLOCK_CLASSES = classes("published", "year_label", "publisher", *TEXTS)
ORACLE["match_year_publisher"] = f"""WITH {PARTS}, {_PUBLISHED}, {_BLOCK_CLASSES},
  sets AS (SELECT *, {chars('author_names')} AS s1, {chars('paper_title')} AS s2 FROM classes),
  scored AS (SELECT x.year_label, x.publisher, x.rep1, y.rep2, x.n1, y.n2,
      ({jaccard('x.s1', 'y.s1')} + {jaccard('x.s2', 'y.s2')}) / 2 AS sim
    FROM sets x JOIN sets y USING (year_label, publisher) WHERE x.n1 > 0 AND y.n2 > 0)
  SELECT year_label, publisher, {_PAIR_COLUMNS} FROM scored WHERE sim >= 0.7"""
ORACLE["match_key_strict"] = f"""WITH {DOCS},
  keyed AS (SELECT *, {_YEAR_VENUE} AS blocking_key FROM docs),
  {classes('keyed', 'blocking_key', 'paper_title')},
  sets AS (SELECT *, {tokens('paper_title')} AS s FROM classes),
  scored AS (SELECT x.blocking_key, x.rep1, y.rep2, x.n1, y.n2, {jaccard('x.s', 'y.s')} AS sim
    FROM sets x JOIN sets y USING (blocking_key) WHERE x.n1 > 0 AND y.n2 > 0)
  SELECT blocking_key, {_PAIR_COLUMNS} FROM scored WHERE sim > 0.7"""

# ----------------------------------------------------------------------------- similarities


def _similarity(score: str, parts: bool) -> str:
    pairs = (
        title_pairs("p", 0.3, jaccard, tokens, PARTS, "parts") if parts else title_pairs("p", 0.5)
    )
    table = "parts" if parts else "titles"
    return f"""WITH {pairs} SELECT rep1, rep2, round({score}, 6) AS score FROM p
      JOIN (SELECT "index" AS rep1, paper_title AS x FROM {table}) USING (rep1)
      JOIN (SELECT "index" AS rep2, paper_title AS y FROM {table}) USING (rep2)"""


ORACLE["sim_jaccard_tokens"] = _similarity(jaccard(tokens("x"), tokens("y")), False)
ORACLE["sim_jaccard_chars"] = _similarity(jaccard(chars("x"), chars("y")), False)
ORACLE["sim_jaccard_ngrams"] = _similarity(
    jaccard(f"list_distinct({grams('x', 3)})", f"list_distinct({grams('y', 3)})"), False
)
ORACLE["sim_dice_chars"] = _similarity(dice(chars("x"), chars("y")), False)
ORACLE["sim_dice_items"] = _similarity(dice(tokens("x"), tokens("y")), False)
ORACLE["sim_exact"] = _similarity(
    f"(list_sort({tokens('x')}) = list_sort({tokens('y')}))::int::double", False
)
ORACLE["sim_edit_tokens"] = _similarity(edit(tokens("x"), tokens("y")), True)
ORACLE["sim_edit_chars"] = _similarity(
    "1 - levenshtein(x, y) / greatest(length(x), length(y))", True
)

# --------------------------------------------------------------------- clusters and evaluation


def _components(threshold: float) -> str:
    return f"""WITH RECURSIVE {title_pairs('p', threshold)},
      e AS (SELECT 'a:' || rep1 AS u, 'b:' || rep2 AS v FROM p UNION
        SELECT 'b:' || rep2, 'a:' || rep1 FROM p),
      r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
      roots AS (SELECT u AS rep, min(v) AS cluster_id FROM r GROUP BY u),
      members AS (SELECT side || ':' || min("index") OVER (PARTITION BY side, paper_title) AS rep,
        side, "index", side || ':' || "index" AS id FROM titles),
      clusters AS (SELECT cluster_id, id FROM members JOIN roots USING (rep))"""


ORACLE["clusters_components"] = f"{_components(0.7)} SELECT cluster_id, id FROM clusters"
ORACLE["cluster_count"] = (
    f"{_components(0.7)} SELECT count(DISTINCT cluster_id) AS clusters FROM clusters"
)
ORACLE["unmatched_resolved"] = f"""{_components(0.7).replace('WITH RECURSIVE', f'WITH RECURSIVE {DOCS},')}
  SELECT side || ':' || "index" AS id, * FROM docs
  WHERE side || ':' || "index" NOT IN (SELECT id FROM clusters WHERE id <> cluster_id)"""
# Pairs of records, each with the representatives of its two classes.
_RECORD_PAIRS = """recs AS (SELECT side, "index", paper_title,
    min("index") OVER (PARTITION BY side, paper_title) AS rep FROM titles),
  rp AS MATERIALIZED (SELECT 'a:' || x.rep AS rep1, 'b:' || y.rep AS rep2, 'a:' || x."index" AS id1,
      'b:' || y."index" AS id2, sim
    FROM p JOIN recs x ON x.side = 'a' AND x.rep = p.rep1 JOIN recs y ON y.side = 'b' AND y.rep = p.rep2)"""
ORACLE["clusters_first_fit"] = f"""WITH RECURSIVE {title_pairs('p', 0.5)}, {_RECORD_PAIRS},
  n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rep1, rep2, id1, id2) AS seq FROM rp),
  step AS MATERIALIZED (SELECT x.seq AS p, y.seq AS q FROM n x JOIN n y
    ON y.seq < x.seq AND (x.id1 = y.id1 OR x.id2 = y.id2)),
  up(p, q) AS (SELECT seq, seq FROM n UNION SELECT up.p, step.q FROM up JOIN step ON up.q = step.p),
  label AS (SELECT p AS seq, min(q) AS first FROM up GROUP BY p),
  held AS (SELECT first, unnest([id1, id2]) AS id FROM n JOIN label USING (seq))
  SELECT DISTINCT f.id1 || '|' || f.id2 AS cluster_id, held.id FROM held JOIN n f ON f.seq = first"""

_LOOSE_STRICT = f"""WITH {title_pairs('p', 0.5)}, {_RECORD_PAIRS},
  loose AS (SELECT id1, id2 FROM rp), strict_pairs AS (SELECT id1, id2 FROM rp WHERE sim >= 0.85)"""
_METRICS = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))
    ELSE 0 END, 6) AS f_measure"""
ORACLE["evaluate_pairs"] = f"""{_LOOSE_STRICT}, c AS (SELECT
    (SELECT count(*) FROM (SELECT * FROM loose INTERSECT SELECT * FROM strict_pairs)) AS tp,
    (SELECT count(*) FROM (SELECT * FROM strict_pairs EXCEPT SELECT * FROM loose)) AS fp,
    (SELECT count(*) FROM (SELECT * FROM loose EXCEPT SELECT * FROM strict_pairs)) AS fn)
  SELECT tp, fp, fn, {_METRICS} FROM c"""
ORACLE["pairs_subset"] = f"""{_LOOSE_STRICT}
  SELECT '85 in 50' AS question, NOT EXISTS (SELECT * FROM strict_pairs EXCEPT SELECT * FROM loose) AS contained
  UNION ALL
  SELECT '50 in 85', NOT EXISTS (SELECT * FROM loose EXCEPT SELECT * FROM strict_pairs)"""
ORACLE["pair_set_ops"] = f"""{_LOOSE_STRICT}, c AS (
    SELECT *, 'common' AS part FROM (SELECT * FROM loose INTERSECT SELECT * FROM strict_pairs) UNION ALL
    SELECT *, 'missing' FROM (SELECT * FROM loose EXCEPT SELECT * FROM strict_pairs))
  SELECT rep1 AS id1, rep2 AS id2, count(DISTINCT id1) AS n1, count(DISTINCT id2) AS n2, part
  FROM c JOIN rp USING (id1, id2) GROUP BY ALL"""
_UPPER = initials_key(TEXTS).replace("author_names", upper("author_names")).replace("paper_title", upper("paper_title"))
ORACLE["blocks_equal"] = f"""WITH {PARTS},
  k AS (SELECT {initials_key(TEXTS)} AS b, "index" FROM parts),
  t AS (SELECT array_to_string(list_transform(list_filter(string_split(author_names || ' ' || paper_title, ' '),
      lambda w: w <> ''), lambda w: w[1:1]), '') AS b, "index" FROM parts),
  u AS (SELECT {_UPPER} AS b, "index" FROM parts),
  f AS (SELECT md5(author_names || paper_title) AS b, "index" FROM parts)
  SELECT 'same initials' AS other, NOT EXISTS (SELECT * FROM k EXCEPT SELECT * FROM t) AND
    NOT EXISTS (SELECT * FROM t EXCEPT SELECT * FROM k) AS equal UNION ALL
  SELECT 'other case', NOT EXISTS (SELECT * FROM k EXCEPT SELECT * FROM u) AND
    NOT EXISTS (SELECT * FROM u EXCEPT SELECT * FROM k) UNION ALL
  SELECT 'full text', NOT EXISTS (SELECT * FROM k EXCEPT SELECT * FROM f)"""


def _scores(keys: dict[str, str], table: str, pair_tables: dict[float, str]) -> str:
    """Every key against every baseline: ids are matched by value, copies count by n1 · n2."""
    keyed = " UNION ALL ".join(
        f"SELECT '{name}' AS config, rep1, rep2, n1, n2, md5({key}) AS key FROM {table}"
        for name, key in keys.items()
    )
    pairs = " UNION ALL ".join(
        f"SELECT {t}::double AS threshold, rep1, rep2, n1 * n2 AS n FROM {p}"
        for t, p in pair_tables.items()
    )
    grid = " UNION ALL ".join(
        f"SELECT '{name}' AS config, {t}::double AS threshold" for name in keys for t in pair_tables
    )
    return f"""keyed AS MATERIALIZED ({keyed}), pairs AS MATERIALIZED ({pairs}), grid AS ({grid}),
      sizes AS (SELECT config, key, sum(n1) AS n1, sum(n2) AS n2 FROM keyed WHERE key IS NOT NULL
        GROUP BY ALL),
      found AS (SELECT config, sum(n1 * n2) AS found FROM sizes GROUP BY config),
      totals AS (SELECT threshold, sum(n) AS total FROM pairs GROUP BY threshold),
      hits AS (SELECT threshold, x.config, sum(n) AS tp FROM pairs
        JOIN keyed x ON x.rep1 = pairs.rep1 JOIN keyed y ON y.rep2 = pairs.rep2
        WHERE x.config = y.config AND x.key = y.key GROUP BY ALL),
      c AS (SELECT config, threshold, coalesce(tp, 0)::bigint AS tp,
          (coalesce(found, 0) - coalesce(tp, 0))::bigint AS fp,
          (coalesce(total, 0) - coalesce(tp, 0))::bigint AS fn
        FROM grid LEFT JOIN found USING (config) LEFT JOIN totals USING (threshold)
        LEFT JOIN hits USING (config, threshold))
      SELECT config, threshold, tp, fp, fn, {_METRICS} FROM c"""


ORACLE["evaluate_blocking"] = f"""WITH {title_pairs('p', 0.7)},
  {_scores({'initial_h': initials('paper_title'), 'length': 'length(paper_title)::varchar'},
           'classes', {0.7: 'p'})}"""

# ----------------------------------------------------------------------------------- sweeps

COLUMN_SETS = {
    "a": ORDER[:1],
    "p": ORDER[1:2],
    "ap": TEXTS,
    "apy": (*TEXTS, "year"),
    "appv": (*TEXTS, "publication_venue"),
    "appvy": (*TEXTS, "publication_venue", "year"),
}
LENGTH_SETS = COLUMN_SETS | {
    "apv": ("author_names", "publication_venue"),
    "ay": ("author_names", "year"),
    "apvy": ("author_names", "publication_venue", "year"),
    "ppv": ("paper_title", "publication_venue"),
    "ppvy": ("paper_title", "publication_venue", "year"),
}


def _short(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) < {n} THEN '' ELSE {x} END)"


def _sweep_keys() -> dict[str, str]:
    """Keys over precomputed columns: ia, ip (initials), venue (canonical), label."""
    part = {"author_names": "ia", "paper_title": "ip", "year": "year::varchar", "publication_venue": "venue"}
    outer = "label || '-' || venue || '-' || "
    keys = {}
    for name, columns in COLUMN_SETS.items():
        key = "(" + " || ".join(part[c] for c in columns) + ")"
        inner = {
            "initial_n2": _short(key, 2),
            "initial_n3": _short(key, 3),
            "initial_h": key,
            "h": "(" + " || ".join(f"{c}::varchar" for c in columns) + ")",
        }
        keys |= {f"{method}/{name}": value for method, value in inner.items()}
        for n in (2, 3):
            full = ["venue" if c == "publication_venue" else f"{c}::varchar" for c in columns]
            keys[f"n{n}/{name}"] = " || chr(31) || ".join(_short(c, n) for c in full)
        if name in ("a", "p", "ap"):
            keys |= {f"sorted_{m}/{name}": outer + value for m, value in inner.items()}
    for name, columns in LENGTH_SETS.items():
        keys[f"length/{name}"] = "'' || " + " || '_' || ".join(
            f"length({c}::varchar)" for c in columns
        )
    return keys


ORACLE["sweep_blockings"] = f"""WITH {_SETS}, {baseline('p70', 0.7)}, {baseline('p85', 0.85)},
  ready AS MATERIALIZED (SELECT *, {initials('author_names')} AS ia, {initials('paper_title')} AS ip,
    {language('publication_venue')} AS venue, {year_label('year')} AS label FROM classes),
  {_scores(_sweep_keys(), 'ready', {0.7: 'p70', 0.85: 'p85'})}"""


def _column_sweep() -> str:
    variants = [("'full'", ()), (_YEAR_VENUE, ())]
    variants += [(f"'{'_'.join(names)}'", names) for names in PAIRED]
    parts = " UNION ALL ".join(
        f"""SELECT {dataset} AS dataset, side, {initials(augment('author_names', names))} AS author_names,
        {initials(augment('paper_title', names))} AS paper_title, year::varchar AS year,
        {language(augment('publication_venue', names))} AS publication_venue FROM docs"""
        for dataset, names in variants
    )
    sets = [c for size in range(1, 5) for c in combinations(ORDER, size)]
    keyed = " UNION ALL ".join(
        f"""SELECT dataset, side, '{"+".join(c)}' AS columns, md5({" || ".join(c)}) AS key FROM parts_of"""
        for c in sets
    )
    return f"""WITH {DOCS}, parts_of AS MATERIALIZED ({parts}), keyed AS ({keyed}),
      sizes AS (SELECT dataset, columns, key, count(*) FILTER (side = 'a') AS n1,
        count(*) FILTER (side = 'b') AS n2 FROM keyed WHERE dataset IS NOT NULL GROUP BY ALL)
      SELECT dataset, columns, count(*) FILTER (n1 > 0) AS blocks1, count(*) FILTER (n2 > 0) AS blocks2,
        sum(n1 * n2)::bigint AS matches FROM sizes GROUP BY ALL"""


ORACLE["sweep_columns"] = _column_sweep()


def _column_scores() -> str:
    """Every column set on every dataset, each baseline pair looked up under each key."""
    variants = [("'full'", ()), (_YEAR_VENUE, ())]
    variants += [(f"'{'_'.join(names)}'", names) for names in PAIRED]
    parts = " UNION ALL ".join(
        f"""SELECT {dataset} AS dataset, rep1, rep2, n1, n2, {initials(augment('author_names', names))} AS author_names,
        {initials(augment('paper_title', names))} AS paper_title, year::varchar AS year,
        {language(augment('publication_venue', names))} AS publication_venue FROM classes"""
        for dataset, names in variants
    )
    sets = [c for size in range(1, 5) for c in combinations(ORDER, size)]
    keyed = " UNION ALL ".join(
        f"""SELECT dataset, rep1, rep2, n1, n2, '{"+".join(c)}' AS columns, md5({" || ".join(c)}) AS key FROM parts_of
        WHERE dataset IS NOT NULL"""
        for c in sets
    )
    return f"""WITH {_SETS}, {baseline('p70', 0.7)}, {baseline('p85', 0.85)},
      parts_of AS MATERIALIZED ({parts}), keyed AS MATERIALIZED ({keyed}),
      pairs AS (SELECT 0.7::double AS threshold, rep1, rep2, n1 * n2 AS n FROM p70 UNION ALL
        SELECT 0.85::double, rep1, rep2, n1 * n2 FROM p85),
      sizes AS (SELECT dataset, columns, key, sum(n1) AS n1, sum(n2) AS n2 FROM keyed WHERE key IS NOT NULL GROUP BY ALL),
      found AS (SELECT dataset, columns, sum(n1 * n2) AS found FROM sizes GROUP BY ALL),
      looked AS (SELECT threshold, x.dataset, x.columns, sum(n) AS total,
          coalesce(sum(n) FILTER (x.key = y.key), 0) AS tp
        FROM pairs JOIN keyed x ON x.rep1 = pairs.rep1 JOIN keyed y ON y.rep2 = pairs.rep2
        WHERE x.dataset = y.dataset AND x.columns = y.columns GROUP BY ALL),
      c AS (SELECT dataset, columns, t.threshold, coalesce(tp, 0)::bigint AS tp,
          (found - coalesce(tp, 0))::bigint AS fp, (coalesce(total, 0) - coalesce(tp, 0))::bigint AS fn
        FROM found CROSS JOIN (VALUES (0.7::double), (0.85::double)) AS t(threshold)
        LEFT JOIN looked USING (dataset, columns, threshold))
      SELECT dataset, columns, threshold, tp, fp, fn, {_METRICS} FROM c"""


ORACLE["sweep_column_scores"] = _column_scores()


def _scored_sweep() -> str:
    """Similarities of distinct values first, then all pairs of value combinations under every configuration."""
    brand = lambda x: f"CASE WHEN contains({x}, 'Brand#1') THEN 'one' ELSE 'other' END"
    gram_set = lambda x, n: f"list_distinct({grams(x, n)})"
    outer = f"{year_label('year')} || '-' || {brand('publication_venue')}"
    venue = brand("publication_venue")
    rows, sims = [], []
    for name, columns in COLUMN_SETS.items():
        texts = [c for c in columns if c in TEXTS]
        key = initials_key(texts)
        year = "year::varchar" if "year" in columns else "''"
        place = venue if "publication_venue" in columns else "''"
        two = texts[1] if len(texts) > 1 else "''"
        size = len(columns)
        row = "SELECT '{}' AS config, side, \"index\", {} AS outer_key, '{}' AS kind, {} AS x, {} AS y, {} AS year, {} AS venue, {} AS size, {} AS texts FROM parts"
        for n in (2, 3):
            rows.append(row.format(f"initial_n{n}/{name}", "''", f"g{n}", key, "''", year, place, size - len(texts) + 1, 1))
            rows.append(row.format(f"n{n}/{name}", "''", f"g{n}", texts[0], two, year, place, size, len(texts)))
            if name in ("a", "p", "ap"):
                rows.append(row.format(f"sorted_initial_n{n}/{name}", outer, f"g{n}", key, "''", "''", "''", 1, 1))
        if name in ("a", "p", "ap"):
            rows.append(row.format(f"sorted/{name}", outer, "ch", texts[0], two, "''", "''", size, len(texts)))
    for kind, items in (("g2", lambda x: gram_set(x, 2)), ("g3", lambda x: gram_set(x, 3)), ("ch", chars)):
        sims.append(f"SELECT kind, v, {items('v')} AS items FROM vals WHERE kind = '{kind}'")
    return f"""WITH {PARTS}, r AS MATERIALIZED ({" UNION ALL ".join(rows)}),
      vals AS (SELECT DISTINCT kind, x AS v FROM r UNION SELECT DISTINCT kind, y FROM r WHERE texts > 1),
      sets AS MATERIALIZED ({" UNION ALL ".join(sims)}),
      sims AS MATERIALIZED (SELECT a.kind, a.v AS v1, b.v AS v2, {jaccard('a.items', 'b.items')} AS s
        FROM sets a JOIN sets b USING (kind)),
      c AS MATERIALIZED (SELECT config, kind, side, outer_key, x, y, year, venue, size, texts, count(*) AS n
        FROM r WHERE outer_key IS NOT NULL GROUP BY ALL),
      scored AS (SELECT a.config, a.n * b.n AS n, (sx.s + CASE WHEN a.texts > 1 THEN sy.s ELSE 0 END
          + CASE WHEN a.venue <> '' AND a.venue = b.venue THEN 1.0 ELSE 0 END
          + CASE WHEN a.year <> '' AND a.year = b.year THEN 1.0 ELSE 0 END) / a.size AS sim
        FROM c a JOIN c b ON a.side = 'a' AND b.side = 'b' AND a.config = b.config AND a.outer_key = b.outer_key
        JOIN sims sx ON sx.kind = a.kind AND sx.v1 = a.x AND sx.v2 = b.x
        LEFT JOIN sims sy ON sy.kind = a.kind AND sy.v1 = a.y AND sy.v2 = b.y AND a.texts > 1),
      t AS (SELECT * FROM (VALUES (0.7::double), (0.85::double)) AS v(threshold)),
      found AS (SELECT config, threshold, sum(n) AS found FROM scored JOIN t ON sim >= threshold GROUP BY ALL),
      whole AS MATERIALIZED (SELECT side, author_names, paper_title, year, publication_venue, count(*) AS n FROM parts GROUP BY ALL),
      word_sets AS (SELECT DISTINCT v, {tokens('v')} AS items
        FROM (SELECT author_names AS v FROM parts UNION SELECT paper_title FROM parts)),
      word_sims AS MATERIALIZED (SELECT a.v AS v1, b.v AS v2, {jaccard('a.items', 'b.items')} AS s FROM word_sets a, word_sets b),
      base AS MATERIALIZED (SELECT a.author_names AS a1, a.paper_title AS p1, a.year AS y1, a.publication_venue AS v1,
          b.author_names AS a2, b.paper_title AS p2, b.year AS y2, b.publication_venue AS v2, a.n * b.n AS n,
          (sa.s + sp.s + CASE WHEN a.year = b.year THEN 1.0 ELSE 0 END
            + CASE WHEN a.publication_venue = b.publication_venue THEN 1.0 ELSE 0 END) / 4 AS sim
        FROM whole a JOIN whole b ON a.side = 'a' AND b.side = 'b'
        JOIN word_sims sa ON sa.v1 = a.author_names AND sa.v2 = b.author_names
        JOIN word_sims sp ON sp.v1 = a.paper_title AND sp.v2 = b.paper_title WHERE sim >= 0.7),
      totals AS (SELECT threshold, sum(n) AS total FROM base JOIN t ON sim >= threshold GROUP BY ALL),
      ids AS MATERIALIZED (SELECT DISTINCT ON (config, w) r.config, w, kind, outer_key, x, y, r.year, r.venue, size, texts
        FROM r JOIN (SELECT "index", md5(author_names || chr(31) || paper_title || chr(31) || year || chr(31) || publication_venue) AS w
          FROM parts) p USING ("index")),
      hits AS (SELECT a.config, threshold, sum(n) AS tp FROM base
        JOIN t ON base.sim >= threshold
        JOIN ids a ON a.w = md5(a1 || chr(31) || p1 || chr(31) || y1 || chr(31) || v1)
        JOIN ids b ON b.w = md5(a2 || chr(31) || p2 || chr(31) || y2 || chr(31) || v2) AND b.config = a.config
          AND a.outer_key = b.outer_key
        JOIN sims sx ON sx.kind = a.kind AND sx.v1 = a.x AND sx.v2 = b.x
        LEFT JOIN sims sy ON sy.kind = a.kind AND sy.v1 = a.y AND sy.v2 = b.y AND a.texts > 1
        WHERE (sx.s + CASE WHEN a.texts > 1 THEN sy.s ELSE 0 END
          + CASE WHEN a.venue <> '' AND a.venue = b.venue THEN 1.0 ELSE 0 END
          + CASE WHEN a.year <> '' AND a.year = b.year THEN 1.0 ELSE 0 END) / a.size >= threshold GROUP BY ALL),
      counts AS (SELECT config, threshold, coalesce(tp, 0)::bigint AS tp, (coalesce(found, 0) - coalesce(tp, 0))::bigint AS fp,
          (coalesce(total, 0) - coalesce(tp, 0))::bigint AS fn
        FROM (SELECT DISTINCT config FROM r) CROSS JOIN t LEFT JOIN found USING (config, threshold)
        LEFT JOIN hits USING (config, threshold) LEFT JOIN totals USING (threshold))
      SELECT config, threshold, tp, fp, fn, {_METRICS} FROM counts"""


ORACLE["sweep_scored"] = _scored_sweep()


def _augment_sweep() -> str:
    names = ("identity", "lower", "title", "alphanumerical", "reverse")
    chosen = [c for size in range(1, 5) for c in combinations(names, size)]
    keyed = " UNION ALL ".join(
        f"""SELECT '{" ".join(c)}' AS augmentations, side, md5({initials(augment('paper_title', c))}) AS key
        FROM titles"""
        for c in chosen
    )
    return f"""WITH {TITLES}, keyed AS ({keyed}),
      sizes AS (SELECT augmentations, key, count(*) FILTER (side = 'a') AS n1,
        count(*) FILTER (side = 'b') AS n2 FROM keyed GROUP BY ALL)
      SELECT augmentations, sum(n1 * n2)::bigint AS matches FROM sizes GROUP BY ALL"""


ORACLE["sweep_augment"] = _augment_sweep()
ORACLE["replicate"] = f"""WITH {PARTS} SELECT r::int AS replica,
  CASE WHEN r > 0 THEN "index" || '-' || r ELSE "index" END AS "index",
  CASE WHEN r > 0 THEN paper_title || ' ' || r ELSE paper_title END AS paper_title
  FROM parts, range(3) AS t(r)"""
ORACLE["replication_sweep"] = f"""WITH {TITLES}, i AS (SELECT side, {initials('paper_title')} AS k FROM titles),
  copies AS (SELECT side, r, CASE WHEN r > 0 THEN k || r ELSE k END AS k FROM i, range(10) AS t(r)),
  sizes AS (SELECT factor, k, count(*) FILTER (side = 'a') AS n1, count(*) FILTER (side = 'b') AS n2
    FROM copies, range(1, 11) AS f(factor) WHERE r < factor GROUP BY ALL)
  SELECT factor::int AS factor, sum(n1 + n2)::bigint AS records, sum(n1 * n2)::bigint AS matches
  FROM sizes GROUP BY factor"""

# ------------------------------------------------------------------------------ round trips

ORACLE["roundtrip_citations"] = ORACLE["parse_citations"]
ORACLE["roundtrip_records"] = ORACLE["prepare_records"]
ORACLE["roundtrip_pairs"] = f"WITH {title_pairs('p', 0.7)} SELECT rep1 AS id1, rep2 AS id2 FROM p"
ORACLE["roundtrip_scores"] = ORACLE["baseline_jac_title_70"]
ORACLE["roundtrip_clusters"] = ORACLE["clusters_components"]
ORACLE["roundtrip_raw_records"] = f"""WITH {DOCS}
  SELECT paper_title, author_names, year, publication_venue, "index" FROM docs UNION ALL
  SELECT nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), html,
    nullif(regexp_extract(url, '/([0-9]+)(?:$|[?#])', 1), '')::int, regexp_extract(url, '/([a-z]{{2}})/', 1),
    'p' || page_id FROM pages"""

# ------------------------------------------------------------------------- edit similarity


def _ratio_pairs(rows: str, threshold: float) -> str:
    """All pairs of distinct ASCII texts, compared one by one."""
    return f"""WITH {rows}, t AS (SELECT side, text, min("index") AS rep, count(*) AS n FROM texts GROUP BY ALL),
      p AS (SELECT a.rep AS rep1, b.rep AS rep2, a.n AS n1, b.n AS n2,
        1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) AS sim
        FROM t a JOIN t b ON a.side = 'a' AND b.side = 'b')
      SELECT rep1, rep2, n1, n2, round(sim, 6) AS sim FROM p WHERE sim >= {threshold}"""


ORACLE["match_title_ratio_85"] = _ratio_pairs(f'{PARTS}, texts AS (SELECT side, paper_title AS text, "index" FROM parts)', 0.85)
ORACLE["match_url_ratio_85"] = _ratio_pairs(
    """texts AS (SELECT CASE WHEN regexp_matches(url, '^https?://(m|blog)[.]') THEN 'a' ELSE 'b' END AS side,
      url AS text, page_id::varchar AS "index" FROM pages)""", 0.85)

# -------------------------------------------------------------- bins from a table, stored blocks

ORACLE["block_year_bins"] = f"""WITH {PARTS}, bins AS (SELECT s_nationkey + 1990 AS low,
    s_nationkey + 1991 + s_suppkey % 5 AS high, 's' || s_suppkey AS label FROM supplier)
  SELECT label, count(*) AS records, min(year) AS first, max(year) AS last FROM parts JOIN bins
  ON year >= low AND year < high GROUP BY label"""
ORACLE["block_price_bins"] = """SELECT p_partkey AS label, count(*) AS customers, sum(c_custkey)::bigint AS keys
  FROM customer JOIN part ON c_acctbal >= p_retailprice AND c_acctbal < p_retailprice + 0.5 + p_size GROUP BY 1"""
ORACLE["match_stored_blocks"] = f"""WITH {DOCS}, k AS (SELECT md5({initials('paper_title')}) AS value, side, "index" FROM docs),
  sizes AS (SELECT value, count(*) FILTER (side = 'a') AS n1, count(*) FILTER (side = 'b') AS n2 FROM k GROUP BY value)
  SELECT DISTINCT value, side, "index", n1, n2 FROM k JOIN sizes USING (value) WHERE n1 > 0 AND n2 > 0"""


def _edit_titles(threshold: float) -> str:
    """Edit distance of sorted token lists without symbols or matrices: tokens that stay equal are a chain of common tokens,
    and what lies between two of them costs the longer of both gaps. The cheapest chain is found from place to place."""
    size = "(len(a) + len(b))"
    return f"""WITH {TITLES}, {numbered('titles', ('paper_title',), {'s': tokens('paper_title')})}, {overlaps('ov', 's')},
      pairs AS MATERIALIZED (SELECT x.rep1, y.rep2, x.n1, y.n2, list_sort(x.s) AS a, list_sort(y.s) AS b
        FROM ov JOIN sets x ON x.id = i JOIN sets y ON y.id = j
        WHERE greatest(len(x.s), len(y.s)) - o <= {1 - threshold} * (len(x.s) + len(y.s)) + 1e-9),
      common AS MATERIALIZED (SELECT *, list_filter(range(1, len(a) + 1), lambda k: list_contains(b, a[k])) AS places FROM pairs),
      chains AS MATERIALIZED (SELECT *, [0] || places || [len(a) + 1] AS p,
        [0] || list_transform(places, lambda k: list_position(b, a[k])) || [len(b) + 1] AS q FROM common),
      costs AS (SELECT *, list_reduce(list_transform(range(2, len(p) + 1), lambda k: [k::BIGINT]),
        lambda cost, k: list_append(cost, list_min(list_transform(range(1, k[1]),
          lambda m: cost[m] + greatest(p[k[1]] - p[m], q[k[1]] - q[m]) - 1))), [0::BIGINT])[-1] AS d FROM chains),
      scored AS (SELECT rep1, rep2, n1, n2, 1 - d / {size} AS sim FROM costs)
      SELECT rep1, rep2, n1, n2, round(sim, 6) AS sim FROM scored WHERE sim >= {threshold}"""


ORACLE["baseline_edit_title_70"], ORACLE["baseline_edit_title_85"] = _edit_titles(0.7), _edit_titles(0.85)


# ------------------------------------------------------------------------- registries, resolved entities

ORACLE["roundtrip_resolved"] = ORACLE["unmatched_resolved"]
_NAMED_KEYS = {
    "initials_hash": initials_key(TEXTS),
    "full_hash": "author_names || paper_title",
    "initials_ngrams": initials_key(TEXTS),
    "full_ngrams": " || chr(31) || ".join(f"array_to_string({grams(c, 3)}, chr(30))" for c in TEXTS),
    "lengths": "length(author_names) || '_' || length(paper_title)",
    "named_lengths": "length(author_names) || '_' || length(paper_title)",
    "year_ranges": year_label("year"),
    "year_and_venue": _YEAR_VENUE,
}
_KEYED = " UNION ALL ".join(f"SELECT '{name}' AS blocker, {key} AS k FROM parts" for name, key in _NAMED_KEYS.items())
ORACLE["block_by_name"] = f"""WITH {PARTS}, {_PUBLISHED}, keyed AS ({_KEYED}
    UNION ALL SELECT 'year_and_publisher', year_label || '-' || publisher FROM published),
  sizes AS (SELECT blocker, k, count(*) AS n FROM keyed WHERE k IS NOT NULL GROUP BY ALL)
  SELECT blocker, count(*) AS blocks, sum(n)::bigint AS records FROM sizes GROUP BY blocker"""


def _by_similarity() -> str:
    sims = {"jaccard": jaccard("x.s", "y.s"), "dice": dice("x.s", "y.s"), "edit": edit("x.s", "y.s"),
            "ratio": "1 - levenshtein(x.paper_title, y.paper_title) / greatest(length(x.paper_title), length(y.paper_title))"}
    scored = " UNION ALL ".join(
        f"SELECT '{name}' AS similarity, x.rep1, y.rep2, x.n1, y.n2, {sim} AS sim FROM sets x, sets y WHERE x.n1 > 0 AND y.n2 > 0"
        for name, sim in sims.items()
    )
    return f"""WITH {PARTS}, {numbered('parts', ('paper_title',), {'s': tokens('paper_title')})}, scored AS ({scored})
      SELECT similarity, rep1, rep2, n1, n2, round(sim, 6) AS sim FROM scored WHERE sim >= 0.85"""


ORACLE["match_by_similarity"] = _by_similarity()
