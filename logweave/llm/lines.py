"""Line de-duplication by a log-template tree.

A line is parsed by a tree of fixed depth: its token count, then its leading
tokens, then a template. Case is folded and tokens that hold a digit are
variable fields. Below the leading tokens the rest of a longer line falls into
thirds, and a template may also leave one third open, whichever it is: so lines
that differ in one field of words still meet. A template is a hash of what it
fixes; a line belongs to its exact template and, from ``WIDE`` tokens on, to
three open ones. The hashes have 64 bits and are not compared further: among n
templates a given line meets a stranger's with probability n / 2**64.

What is dropped: lines of templates that recur across documents which are not
copies of one another. Copies are told by their words: a line is first held by
the document with the smallest key (a hash of id and text) that has it, and a
document is a copy of another that first holds at least ``PART`` of its tokens if
``COPY`` of both texts' three-word shingles together are common to both. Shingles are
sampled by the size of their first word, where it leaves 3 divided by ``RATE``. Each group of copies
(a connected component) is one witness for its lines, so a group of any size
leaves its own text alone, while a notice goes even if it is most of every text
that has it. A template is boilerplate if enough witnesses hold it:
``FEW`` for lines of at least ``LONG`` tokens, ``MANY`` for those of at least
``SHORT``, else ``MOST``. Its lines are dropped wherever they stand. Lines
without a token stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEADING = 2
WIDE = 12
LONG, SHORT = 8, 3
FEW, MANY, MOST = 2, 3, 10
PART, COPY = 0.1, 0.5
RATE = 4
#: Templates of which lines are looked up where the texts are, and the buckets of that look-up.
COMMON, BUCKETS = 4096, 4096


def _templates(t: Column) -> Column:
    """The templates of a line from its tokens, as hashes; tokens are hashed once, by stretches."""
    n = F.size(t)
    third = F.floor((n - LEADING) / 3).cast("int")
    a, b = F.lit(LEADING) + third, F.lit(LEADING) + 2 * third
    cuts = [F.lit(0), F.lit(LEADING), a, b, n]
    parts = F.struct(*[F.xxhash64(F.slice(t, lo + 1, hi - lo)).alias(f"h{i}") for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    # Bound by a transform of one element, so that each stretch is hashed once.
    wide = F.transform(
        F.array(parts),
        lambda h: F.array(
            F.xxhash64(F.lit(0), n, h["h0"], h["h1"], h["h2"], h["h3"]),
            F.xxhash64(F.lit(1), n, h["h0"], h["h2"], h["h3"]),
            F.xxhash64(F.lit(2), n, h["h0"], h["h1"], h["h3"]),
            F.xxhash64(F.lit(3), n, h["h0"], h["h1"], h["h2"]),
        ),
    )[0]
    return F.when(n >= WIDE, wide).otherwise(F.array(F.xxhash64(F.lit(0), n, t)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, text): the documents that have a text."""
    return docs.where(F.col(text_col).isNotNull()).select(_row(id_col, text_col).alias("did"), F.col(text_col).alias("text"))


def _tokens(texts: DataFrame) -> DataFrame:
    """(did, tokens): the tokens of each line."""
    text = F.lower("text")
    # Texts without a digit have no variable fields to mask.
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(text)
    df = texts.select("did", F.split(masked, "\n", -1).alias("split"), text.alias("text"))
    # Where spaces are the only white space within lines, they are cut without a pattern.
    tokens = F.when(
        F.col("text").rlike(r"[\t\x0B\f\r]"),
        F.transform("split", lambda line: F.regexp_extract_all(line, F.lit(r"(\S+)"), F.lit(1))),
    ).otherwise(F.transform("split", lambda line: F.array_remove(F.split(line, " ", -1), "")))
    return df.select("did", tokens.alias("tokens"))


def parsed(texts: DataFrame) -> DataFrame:
    """(did, total, lines): a row's key, its tokens and its lines that have tokens."""
    lines = F.filter(
        F.transform(
            F.col("tokens"),
            lambda t, i: F.struct(i.alias("pos"), F.size(t).alias("n"), F.when(F.size(t) > 0, _templates(t)).alias("keys")),
        ),
        lambda line: line["n"] > 0,
    )
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + F.size(t))
    return _tokens(texts).select("did", total.alias("total"), lines.alias("lines"))


def samples(texts: DataFrame) -> DataFrame:
    """(did, sample): a row's key and its sampled shingles."""
    flat = _tokens(texts).select("did", F.flatten("tokens").alias("flat"))
    return flat.select("did", _sampled(F.col("flat")).alias("sample"))


def _sampled(t: Column) -> Column:
    """Hashes of sampled three-word shingles, and of the first token pair, so that no text with tokens has none."""
    starts = F.transform(t, lambda w, i: F.when(F.octet_length(w) % RATE == 3, i + 1))
    chosen = F.filter(starts, lambda i: i <= F.size(t) - 2)
    hashes = F.transform(chosen, lambda i: F.hash(F.slice(t, i, F.lit(3))))
    return F.array_distinct(F.concat(F.array(F.hash(F.slice(t, F.lit(1), F.lit(2)))), hashes))


def _row(id_col: str, text_col: str) -> Column:
    """The key of a document: 60 bits of a hash of its id and text."""
    said = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return F.conv(F.left(F.md5(said.cast("binary")), F.lit(15)), 16, 10).cast("long")


def copy_groups(spots: DataFrame, texts: DataFrame) -> DataFrame:
    """(did, copy_of) for each document in a group of copies; ``copy_of`` is the group's smallest key.

    ``spots`` has one row for each document, line and template: did, total, pos, n,
    first (the template's first holder). ``texts``: (did, text); only those of documents in
    a candidate pair are sampled and dealt out. A document has at most
    1 / ``PART`` candidates, however large its group is.
    """
    by_line = spots.where("first <> did").groupBy("did", "pos").agg(F.max("total").alias("total"), F.max("n").alias("n"), F.min("first").alias("first"))
    pairs = (
        by_line.groupBy("did", "first").agg(F.max("total").alias("total"), F.sum("n").alias("n"))
        .where(F.col("n") >= PART * F.col("total")).select("did", F.col("first").alias("holder"))
    )
    pairs = common.durable(pairs, "pairs")
    asked = pairs.select("did").unionAll(pairs.select(F.col("holder").alias("did"))).distinct()
    asked = common.durable(asked, "asked")
    # Not a semi-join, which the planner would move ahead of the sieve.
    held = common.durable(samples(common.sieved(texts, "did", asked)).join(asked, "did").dropDuplicates(["did"]), "samples")
    both = pairs.join(held, "did").join(held.select(F.col("did").alias("holder"), F.col("sample").alias("theirs")), "holder")
    shared = F.size(F.array_intersect("sample", "theirs"))
    edges = both.where(shared >= COPY * (F.size("sample") + F.size("theirs") - shared)).select(F.col("did").alias("a"), F.col("holder").alias("b"))
    return common.components(edges).select(F.col("node").alias("did"), F.col("component").alias("copy_of"))


def boilerplate(texts: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(did, drop): for each document with lines to drop, their numbers (from 0, ascending).

    And where (did, pos) two lines of each of the ``COMMON`` templates with most witnesses stand.

    Every count is combined map-side, so a line that stands in a third of all
    documents is one row of each task; joins on templates are between
    written tables and split hot keys at run time.
    """
    lines = common.durable(parsed(texts), "lines")
    held = lines.select(
        "did", F.explode(F.array_distinct(F.flatten(F.transform("lines", lambda line: line["keys"])))).alias("key")
    )
    # In two documents at least: rows equal in id and text are one.
    recurring = held.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    recurring = common.durable(recurring.select("key", "first"), "recurring")
    places = lines.select("did", "total", F.explode("lines").alias("line")).select("did", "total", "line.pos", "line.n", F.explode("line.keys").alias("key"))
    spots = common.durable(common.sieved(places, "key", recurring.select("key")).join(recurring, "key"), "spots")
    copies = common.durable(copy_groups(spots, texts), "copies")
    witnesses = (
        spots.join(copies, "did", "left")
        .select("key", "n", F.coalesce("copy_of", "did").alias("witness")).distinct()
        .groupBy("key").agg(F.count("*").alias("held"), F.max("n").alias("n"))
        .where(F.col("held") >= F.when(F.col("n") >= LONG, FEW).when(F.col("n") >= SHORT, MANY).otherwise(MOST)).select("key", "held")
    )
    witnesses = common.durable(witnesses, "boilerplate")
    most = witnesses.orderBy(F.desc("held"), "key").limit(COMMON).select("key")
    place = F.struct("did", "pos")
    ends = spots.join(F.broadcast(most), "key").groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).collect()
    examples = sorted({(x["did"], x["pos"]) for r in ends for x in (r["low"], r["high"])})
    return spots.join(witnesses.select("key"), "key").groupBy("did").agg(F.array_sort(F.collect_set("pos")).alias("drop")), examples


def _looked_up(texts: DataFrame, examples: list[tuple[int, int]]) -> DataFrame:
    """One row, ``usual``: hashes of the lines at these places, by buckets; at most two of each of ``COMMON`` templates."""
    spark = texts.sparkSession
    places = spark.createDataFrame(examples, "did long, pos int")
    found = texts.join(F.broadcast(places), "did").select(F.xxhash64(F.get(F.split("text", "\n", -1), F.col("pos"))).alias("h")).distinct()
    table: list[list[int]] = [[] for _ in range(BUCKETS)]
    for (h,) in found.collect():
        table[h % BUCKETS].append(h)
    return spark.createDataFrame([(table,)], "usual array<array<long>>")


def _usual(text: str, usual: str) -> Column:
    """The numbers of a text's lines that are in the look-up, ascending; null if there is none."""
    hashes = F.transform(F.split(F.col(text), "\n", -1), lambda line: F.xxhash64(line))
    at = F.transform(hashes, lambda h, i: F.when(F.array_contains(F.get(F.col(usual), F.pmod(h, F.lit(BUCKETS)).cast("int")), h), i))
    # Bound by an array of one element, so that lines are looked up once.
    return F.get(F.filter(F.array(F.filter(at, lambda i: i.isNotNull())), lambda x: F.size(x) > 0), F.lit(0))


def _drops(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(did, drop, open) for each document with lines to drop, and the look-up.

    ``open``: the look-up doesn't give just those lines. Where it does, a text needs no join.
    """
    examples: list[tuple[int, int]] = []

    def found() -> DataFrame:
        drops, places = boilerplate(texts)
        examples.extend(places)
        return drops

    drops = common.settled(texts.sparkSession, "found", found)
    usual = _looked_up(texts, examples)
    some = common.sieved(texts, "did", drops.select("did")).crossJoin(F.broadcast(usual))
    given = some.select("did", _usual("text", "usual").alias("given")).where("given is not null").groupBy("did").agg(F.first("given").alias("given"))
    return drops.join(given, "did", "full").select("did", "drop", (~F.col("drop").eqNullSafe(F.col("given"))).alias("open")), usual


def drop_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", details: bool = False
) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text and its length set anew.

    Every row stays, even if no line is left. A null text stays null, an empty one
    empty; the rest of a text is as it was. Rows equal in id and text are one
    document, however often they stand there, and are treated alike; ids may be null. An empty table gives an
    empty one. With ``details``, also ``n_lines`` and ``dropped`` (line numbers,
    ascending), in place of columns of these names. Other columns pass through, whatever their names.
    """
    p = common.prefix(docs)
    row, did, drop, some, open_, usual = (f"{p}{x}" for x in ("row", "did", "drop", "some", "open", "usual"))
    looked_up: list[DataFrame] = []

    def found() -> DataFrame:
        drops, table = _drops(_texts(docs, id_col, text_col))
        looked_up.append(table)
        return drops

    drops = common.settled(docs.sparkSession, "drops", found)
    known = drops.where("open").select(F.col("did").alias(did), F.col("drop").alias(drop))
    # Texts that lose nothing, or usual lines only, stay where they are.
    marked = common.marked(docs.withColumn(row, _row(id_col, text_col)), row, drops.select("did"), some)
    marked = common.marked(marked, row, known.select(did), open_)
    table = F.broadcast(looked_up[0].withColumnRenamed("usual", usual))
    given = F.when(F.col(some), _usual(text_col, usual))
    here = marked.where(~F.col(open_)).crossJoin(table).withColumn(drop, given)
    # The look-up comes after the join, as it would be dealt out with each row.
    met = marked.where(F.col(open_)).join(known, F.col(row) == F.col(did), "left").crossJoin(table)
    met = met.withColumn(drop, F.when(F.col(did).isNotNull(), F.col(drop)).otherwise(given))
    # By a set of the numbers, not a search of the list for each line; lines are bound, so that a text is split once.
    both = F.struct(F.split(F.col(text_col), "\n", -1).alias("lines"), F.col(drop).alias("drop"))
    left = F.transform(F.array(both), _without)[0]
    text = F.when(F.col(drop).isNotNull(), left).otherwise(F.col(text_col))
    columns = {c: F.col(c) for c in docs.columns} | {text_col: text.alias(text_col)}
    if length_col and length_col in docs.columns:
        columns[length_col] = F.length(text).cast(docs.schema[length_col].dataType).alias(length_col)
    if details:
        breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
        columns["n_lines"] = F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines")
        numbers = F.array_join(F.transform(drop, lambda i: i.cast("string")), ",")
        columns["dropped"] = F.coalesce(numbers, F.lit("")).alias("dropped")
    met, here = (part.select(*columns.values()) for part in (met, here))
    return met.unionAll(here)


def _without(x: Column) -> Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["drop"])
    return F.array_join(F.transform(stay, lambda i: F.get(x["lines"], i)), "\n")


#: op4 in SQL: the templates are the strings that the hashes stand for.
ORACLE = rf"""
WITH RECURSIVE docs AS (
  SELECT DISTINCT doc_id, text, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), text)), 1, 15))::BIGINT AS did FROM documents WHERE text IS NOT NULL
), tokens AS (
  SELECT DISTINCT did, x.pos - 1 AS pos,
         list_transform(list_filter(regexp_split_to_array(lower(x.line), '[\x09\x0B\x0C\x0D\x20]+'), lambda w: w <> ''),
                        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS t
  FROM docs, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) AS x
), totals AS (SELECT did, sum(len(t)) AS total FROM tokens GROUP BY did),
lines AS (
  SELECT did, pos, t, len(t) AS n, {LEADING} + (len(t) - {LEADING}) // 3 AS a, {LEADING} + 2 * ((len(t) - {LEADING}) // 3) AS b
  FROM tokens WHERE len(t) > 0
), keys AS (
  SELECT did, pos, n, '0 ' || n || ' ' || array_to_string(t, ' ') AS key FROM lines
  UNION ALL SELECT did, pos, n, '1 ' || n || ' ' || array_to_string(t[1:{LEADING}], ' ') || ' | ' || array_to_string(t[a + 1:n], ' ') FROM lines WHERE n >= {WIDE}
  UNION ALL SELECT did, pos, n, '2 ' || n || ' ' || array_to_string(t[1:a], ' ') || ' | ' || array_to_string(t[b + 1:n], ' ') FROM lines WHERE n >= {WIDE}
  UNION ALL SELECT did, pos, n, '3 ' || n || ' ' || array_to_string(t[1:b], ' ') FROM lines WHERE n >= {WIDE}
), recurring AS (SELECT key, min(did) AS first FROM keys GROUP BY key HAVING count(DISTINCT did) > 1),
spots AS (SELECT k.*, first FROM keys k JOIN recurring USING (key)),
by_line AS (SELECT did, pos, max(n) AS n, min(first) AS first FROM spots GROUP BY did, pos),
pairs AS (
  SELECT did, first AS holder FROM by_line JOIN totals USING (did) WHERE first <> did GROUP BY did, first HAVING sum(n) >= {PART}::DOUBLE * max(total)
), flat AS (
  SELECT did, flatten(list(t ORDER BY pos)) AS t FROM tokens WHERE did IN (SELECT did FROM pairs UNION SELECT holder FROM pairs) GROUP BY did
), samples AS (
  SELECT did, list_distinct(list_transform(list_filter(range(1, len(t) - 1), lambda i: strlen(t[i]) % {RATE} = 3),
    lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) || [array_to_string(t[1:2], '  ')]) AS sample FROM flat
), edges AS (
  SELECT p.did AS a, p.holder AS b FROM pairs p JOIN samples x ON x.did = p.did JOIN samples y ON y.did = p.holder
  WHERE len(list_intersect(x.sample, y.sample)) >= {COPY}::DOUBLE * (len(x.sample) + len(y.sample) - len(list_intersect(x.sample, y.sample)))
), ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reached AS (SELECT a AS did, a AS other FROM ways UNION SELECT r.did, w.b FROM reached r JOIN ways w ON w.a = r.other),
copies AS (SELECT did, min(other) AS holder FROM reached GROUP BY did
), boiler AS (
  SELECT key FROM spots LEFT JOIN copies USING (did) GROUP BY key
  HAVING count(DISTINCT coalesce(holder, did)) >= CASE WHEN max(n) >= {LONG} THEN {FEW} WHEN max(n) >= {SHORT} THEN {MANY} ELSE {MOST} END
), drops AS (SELECT DISTINCT did, pos FROM spots JOIN boiler USING (key)),
listed AS (SELECT did, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS dropped, list(pos) AS gone FROM drops GROUP BY did),
sorted AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS l, listed.dropped, listed.gone
  FROM documents d LEFT JOIN docs e ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.text = e.text LEFT JOIN listed USING (did)
)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(dropped, '') AS dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: l[i]), chr(10)) END AS text
FROM sorted
"""
