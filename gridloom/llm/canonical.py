"""Problem 3: free-entered values mapped to the entries of a reference list, in SQL only.

Distinct texts are brought to a key (invisible characters out, Hangul composed, blanks and remarks out, lower case).
Keys that equal a name of the list are settled by an equality join. The others go through a pigeonhole join: a
reference key is cut into k + 1 segments; a text within k edits must hold one of them unchanged, at most k places
off, so an equality join on (key length, segment number, segment) finds all pairs, and levenshtein verifies them.
Texts without an entry are reported through an anti-join, with entry 0. k is 2 for keys of six letters and more, 1 for
four and five, 0 for shorter ones and codes.

Defined results: null and blank texts are not mapped; a text that records moves counts as its last station; a text
as near to two entries has none; repeated rows each get their result; of a reference name occurring under two entries
neither is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import cut, lookup, table

INVISIBLE = r"[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff]"
MOVE = r"\\s*(?:-+>|=+>|\\u2192|\\u21d2|\\u2794|\\u27f6|\\u25b6|\\uff1e|>)\\s*"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}")

#: Hangul letters written one by one, composed: leading, vowel and an optional trailing letter become a syllable.
COMPOSED = r"""
case when {v} rlike '[\\u1100-\\u11ff]' then array_join(transform(
  regexp_extract_all({v}, '(?s)[\\u1100-\\u1112][\\u1161-\\u1175][\\u11a8-\\u11c2]?|.', 0),
  x -> case when length(x) >= 2 and ascii(x) between 4352 and 4370 then decode(unhex(hex(
      44032 + ((ascii(x) - 4352) * 21 + ascii(substr(x, 2, 1)) - 4449) * 28
      + if(length(x) = 3, ascii(substr(x, 3, 1)) - 4519, 0))), 'UTF-16BE') else x end), '') else {v} end"""


def _plain(v: str) -> str:
    bare = f"translate(regexp_replace({v}, '{INVISIBLE}', ''), '{WIDE}', '{NARROW}')"
    return f"regexp_replace({COMPOSED.format(v=bare)}, '[\\\\u00a0\\\\u2000-\\\\u200a\\\\u202f\\\\u205f\\\\u3000\\\\s]+', ' ')"


def _key(v: str) -> str:
    """Lower case without blanks and the marks that abbreviate."""
    return f"lower(regexp_replace({v}, '[\\\\s.,\\u00b7-]+', ''))"


#: Edits allowed by the length of a reference key: none for short names and codes, one, then two.
ALLOWED = "case when key rlike '^[a-z]+[0-9]+$' or length(key) < 4 then 0 when length(key) < 6 then 1 else 2 end"


def mapping(spark: SparkSession, typed: DataFrame, names: DataFrame) -> DataFrame:
    """text, entry_id of every distinct non-blank text of `typed` (column text); entry 0: none is meant.

    `names` has entry_id and name, one row per name of an entry.
    """
    last = f"try_element_at(filter(split({_plain('text')}, '{MOVE}'), x -> trim(x) <> ''), -1)"
    bare = r"trim(regexp_replace(regexp_replace(last, '\\s*\\([^()]*\\)\\s*$', ''), '^[\\s?*.!,:]+|[\\s?*.!,:]+$', ''))"
    texts = spark.sql(f"select distinct text from {{typed}} where trim(text) <> ''", typed=typed)
    stations = spark.sql(f"select text, {bare} as bare from (select text, {last} as last from {{texts}})", texts=texts)
    keys = cut(spark.sql(
        rf"""
        select distinct text, regexp_replace(key, '(담당관)실$', '$1') as key, rank from (
          select text, {_key("bare")} as key, 0 as rank from {{stations}}
          union all
          select text, {_key(r"regexp_replace(bare, '^.*(?:국|실|본부|처|청)\\s+', '')")}, 1 from {{stations}}
            where bare rlike '(?:국|실|본부|처|청)\\s+.')
        where key <> ''""",
        stations=stations,
    ))
    refs = cut(spark.sql(
        rf"""
        select key, max(entry_id) as entry_id, {ALLOWED} as k, length(key) as n
        from (select entry_id, regexp_replace({_key(_plain("name"))}, '(담당관)실$', '$1') as key from {{names}} where name is not null)
        where key <> '' group by key having count(distinct entry_id) = 1""",
        names=names,
    ))
    exact = cut(spark.sql(
        "select text, min_by(entry_id, (rank, entry_id)) as entry_id from {keys} join {refs} using (key) group by text",
        keys=keys,
        refs=refs,
    ))
    segments = spark.sql(
        """
        select key as ref, entry_id, k, n, i, substr(key, div_at + 1, div_to - div_at) as segment, div_at
        from (select *, cast(floor(i * n / (k + 1)) as int) as div_at, cast(floor((i + 1) * n / (k + 1)) as int) as div_to
              from (select *, explode(sequence(0, k)) as i from {refs} where k > 0))""",
        refs=refs,
    )
    # A text's substrings at the places where a reference of about its length may hold a segment.
    probes = spark.sql(
        r"""
        select distinct text, key, n, i, k, substr(key, at + 1, size) as segment from (
          select *, cast(floor(i * n / (k + 1)) as int) + shift as at,
                 cast(floor((i + 1) * n / (k + 1)) as int) - cast(floor(i * n / (k + 1)) as int) as size
          from (select text, key, n, k, i, explode(sequence(-k, k)) as shift
                from (select text, key, n, k, explode(sequence(0, k)) as i
                      from (select text, key, n, case when n < 6 then 1 else 2 end as k
                            from (select text, key, explode(sequence(greatest(length(key) - 2, 4), length(key) + 2)) as n
                                  from {keys} left anti join {exact} using (text))
                            where abs(n - length(key)) <= case when n < 6 then 1 else 2 end))))
        where at >= 0 and at + size <= length(key)""",
        keys=keys,
        exact=exact,
    )
    near = spark.sql(
        """
        select text, entry_id, min(edits) as edits from (
          select distinct text, entry_id, key, ref, k, levenshtein(key, ref) as edits
          from {probes} join {segments} using (n, i, k, segment))
        where edits <= k
        group by text, entry_id""",
        probes=probes,
        segments=segments,
    )
    found = spark.sql(
        """
        select text, entry_id from {exact}
        union all
        select text, max(entry_id) from (select *, min(edits) over (partition by text) as least from {near})
        where edits = least group by text having count(*) = 1""",
        exact=exact,
        near=near,
    )
    return spark.sql("select text, entry_id from {found} union all select text, 0L from {texts} left anti join {found} using (text)", found=found, texts=texts)


def department_names(spark: SparkSession, glossary: DataFrame) -> DataFrame:
    """entry_id, name: source, target and aliases of the departments."""
    return spark.sql(
        """
        select entry_id, explode(concat(array(source, target), coalesce(aliases, array()))) as name
        from {glossary} where category = '기관명' and entry_id is not null""",
        glossary=glossary,
    )


def owner_texts(spark: SparkSession, owners: DataFrame) -> DataFrame:
    """owner_id, text of the rows that name a department."""
    return spark.sql("select owner_id, coalesce(nullif(department_raw, ''), department) as text from {owners} where coalesce(nullif(department_raw, ''), department, '') <> ''", owners=owners)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = owner_texts(spark, table(spark, sf_dir, "reference_owners"))
    to = cut(mapping(spark, typed, department_names(spark, table(spark, sf_dir, "official_translation_glossary"))))
    # A few texts hold most rows: the distinct ones are broadcast or, if they are many, joined by text and salt.
    return lookup(typed.where("trim(text) <> ''"), to, ["text"], "owner_id").select("owner_id", "entry_id")
