"""Personal data: fixed patterns, and terms that give protected entities away.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers; each
distinct value found is a protected entity.  Corpus co-occurrence then tells how
much a term reveals about an entity.  With ``n`` for numbers of documents,

    IC(e)     = -log2(n(e) / N)                      information of the entity
    PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e)))    what the term tells about it
    disclosure(t) = max over e of PMI(t; e) / IC(e)  1: where t is, e is

where ``n(t, e)`` counts documents that have both, wherever in them they stand.  Terms
above ``remove_at`` are removed and terms above ``generalise_at`` replaced by the class
of entity they tell of, wherever in the corpus they stand.  A pair counts only if it
is seen in ``support`` different contexts, so copies prove nothing: different texts that
have both, or different surroundings of the entity that have the term.

All of it is DataFrame operations; positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relafix.storage import bounded_broadcast, cut, stage_table

# Fixed patterns, with the matches of the plain forms but no backtracking over
# long runs: a match starts where its run of characters starts (or where the
# match before it ended), and what has been read is not given back.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# runs of digits with single separators, whole runs of 12 to 19 digits only
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_TERM = r"[\p{L}\p{N}]+"
_CHUNK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_ok(match: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) <= 3) & (F.lpad(digits, 3, "0") <= "255")

    return F.forall(F.split(match, r"\."), small)


_RULES = {
    "email": (_EMAIL, None, "@"),
    "ip": (_IP, _ip_ok, "."),
    "card": (_CARD, lambda m: F.call_function("luhn_check", _digits(m)), None),
    "phone": (_PHONE, lambda m: F.length(_digits(m)).between(9, 15), "+"),
}


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _positions(matches: Column, gaps: Column) -> Column:
    """Array of (start, end, value): running sums of the lengths of gaps and matches.

    Sums go chunk by chunk, so that a text with very many matches costs little
    more than its length.
    """
    span = "struct<start:int,end:int,value:string>"

    def one(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    def many(state: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(state["at"].alias("at"), F.array().cast(f"array<{span}>").alias("out")), one)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    def summed(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / F.lit(_CHUNK)).cast("int")), lambda c: F.slice(pairs, c * _CHUNK + 1, F.lit(_CHUNK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out"))
        return F.flatten(F.aggregate(chunks, start, many)["out"])

    # the gap after the last match has no partner and goes
    return _let(F.filter(F.arrays_zip(matches.alias("value"), gaps.alias("gap")), lambda p: p["value"].isNotNull()), summed)


def _labelled(kind: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def _passing(test):
    return lambda s: test(s["value"])


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``found``: array of (kind number, start, end, value) of all patterns, by start then kind.

    Per kind leftmost and non-overlapping; matches that fail their test are
    dropped without a retry.  A null text has none.
    """
    out = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    for kind, (pattern, _, hint) in _RULES.items():
        matches = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
        out = out.withColumn(f"__{kind}", matches if hint is None else F.when(F.contains("__text", F.lit(hint)), matches).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    parts = []
    for number, (kind, (pattern, test, _)) in enumerate(_RULES.items()):
        found = F.transform(_positions(F.col(f"__{kind}"), F.split("__text", pattern, -1)), _labelled(number))
        if test:
            found = F.filter(found, _passing(test))
        parts.append(F.when(F.size(f"__{kind}") > 0, found).otherwise(none))
    ordered = F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return out.withColumn("found", ordered).drop("__text", *[f"__{k}" for k in KINDS])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def _without_entities(text: Column) -> Column:
    for pattern, _, _ in _RULES.values():
        text = F.regexp_replace(text, pattern, " ")
    return text


def _edge_words(text: Column, span: Column, reach: int) -> Column:
    """What stands within ``reach`` characters of a span, without cut words and other entities."""
    left = F.substring(text, F.greatest(span["start"] - reach + 1, F.lit(1)), F.least(span["start"], F.lit(reach)))
    right = F.substring(text, span["end"] + 1, F.lit(reach))
    left = F.when(span["start"] > reach, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.when(F.length(text) > span["end"] + reach, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    return _without_entities(F.concat(left, F.lit(" "), right))


def _entity(span: Column) -> Column:
    return F.struct(span["kind"].alias("kind"), F.lower(span["value"]).alias("value"))


def disclosing_terms(
    docs: DataFrame, found: DataFrame, text: Column, support: int = 3, generalise_at: float = 0.8, reach: int = 64, broadcast_rows: int = 200_000
) -> DataFrame | None:
    """``term, disclosure, kind`` of terms that disclose at least ``generalise_at``; None if no pair has the support.

    ``kind`` is that of the entity a term tells most about (of equal ones the first of ``KINDS``).

    ``docs`` is counted for ``N`` and ``n(t)``, whole texts of all rows; ``found``
    is the same rows with ``base_spans``.  ``reach`` bounds the surroundings of a
    mention, which are contexts besides the whole texts; what counts for ``n(t, e)``
    is the whole text.  Only terms that have the support are counted in the corpus,
    by a join that broadcasts them if they are at most ``broadcast_rows``.
    """
    held = found.where(F.size("found") > 0).select(F.monotonically_increasing_id().alias("__row"), text.alias("text"), "found", _without_entities(text).alias("clean"))
    around = F.transform("found", lambda s: F.struct(_entity(s).alias("entity"), _edge_words(F.col("text"), s, reach).alias("near")))
    held = held.select("__row", F.xxhash64("clean").alias("context"), _terms(F.col("clean")).alias("terms"), F.array_distinct(around).alias("around"))
    held = stage_table(held, "held")
    mentions = held.select(F.explode("around").alias("a")).select("a.entity", F.xxhash64("a.near").alias("context"), F.explode(_terms(F.col("a.near"))).alias("term"))
    # contexts are few distinct hashes per pair; distinct first, so that hot pairs shrink before they meet
    near = mentions.distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    near = cut(near.select("entity", "term", F.lit(True).alias("is_near")))
    holds = held.select("__row", "context", F.explode(F.array_distinct(F.transform("around", lambda a: a["entity"]))).alias("entity"))
    total = F.lit(float(docs.count()))
    entities = holds.groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    entities = entities.join(near.select("entity", "is_near").distinct(), "entity", "left").where(((F.col("texts") >= support) | F.col("is_near")) & (F.col("n_entity") < total))
    # A term can reach the threshold only if n(t) is at most n(t, e) * (N / n(e)) ** (1 - threshold), n(t, e) being n(e) at most;
    # the documents with any entity that have it are a part of n(t), which rules frequent words out before pairs are made.
    slack = F.pow(total / F.col("n_entity"), 1.0 - generalise_at) * (1 + 1e-9)
    entities = cut(entities.select("entity", "n_entity", slack.alias("slack")))
    most = entities.agg(F.max(F.col("n_entity") * F.col("slack"))).first()[0]
    if most is None:
        return None
    words = held.select("__row", "context", F.explode("terms").alias("term"))
    n_near = words.groupBy("term").agg(F.count("*").alias("n_near")).where(F.col("n_near") <= most)
    n_near = n_near.join(near.select("term", "is_near").distinct(), "term", "left").where((F.col("n_near") >= support) | F.col("is_near"))
    n_near = cut(n_near.select("term", "n_near"))
    kept = holds.select("__row", "entity").join(bounded_broadcast(entities, broadcast_rows), "entity")
    both = words.join(bounded_broadcast(n_near, broadcast_rows), "term").join(kept, "__row").where(F.col("n_near") <= F.col("n_entity") * F.col("slack"))
    pair = ["entity", "term", "n_entity", "slack", "n_near"]
    together = both.groupBy(*pair, "context").agg(F.count("*").alias("n")).groupBy(*pair).agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
    together = together.where(F.col("n_near") <= F.col("n_both") * F.col("slack")).join(bounded_broadcast(near, broadcast_rows), ["entity", "term"], "left")
    hopeful = cut(together.where((F.col("texts") >= support) | F.col("is_near")).select("entity", "term", "n_both", "n_entity"))
    if hopeful.isEmpty():
        return None
    corpus = docs.select(F.explode(_terms(text)).alias("term"))
    corpus = corpus.join(bounded_broadcast(hopeful.select("term").distinct(), broadcast_rows), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    revealed = F.log2(total * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    information = -F.log2(F.col("n_entity") / total)
    scored = hopeful.join(corpus, "term").withColumn("told", revealed / information).where(F.col("told") >= generalise_at)
    most = F.max_by("entity.kind", F.struct("told", -F.col("entity.kind")))
    return cut(scored.groupBy("term").agg(F.max("told").alias("disclosure"), most.alias("kind")))


def _quoted(terms: Column) -> Column:
    # terms hold letters and digits only, so they need no quoting
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.sort_array(terms), "|"), F.lit(r")(?![\p{L}\p{N}])"))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.9, reach: int = 64, broadcast_rows: int = 200_000
) -> DataFrame:
    """``docs`` with ``found`` and ``told``: the spans of patterns and of disclosing terms.

    ``found`` holds (kind, start, end, value), kind a place in ``KINDS``; ``told``
    holds (start, end, value, disclosure, kind), the kind of entity that the term tells
    of.  Terms are whole runs of letters and digits of any length; they are counted in
    whole texts, and ``reach`` only bounds what counts as a further context of a
    mention.  One row per row of ``docs``.  Null and
    empty texts have no spans.  Null and repeated ids and repeated rows are kept:
    terms are matched by id and text together.  An empty table gives an empty
    result.  ``docs`` must not have columns ``found`` or ``told`` of its own;
    ``sanitise`` and the digest take care of that by packing the row first.
    """
    text = F.col(text_col)
    found = base_spans(docs, text)
    flagged = disclosing_terms(docs, found, text, support, generalise_at, reach, broadcast_rows)
    none = F.array().cast("array<struct<start:int,end:int,value:string,disclosure:double,kind:int>>")
    if flagged is None or flagged.isEmpty():
        return found.withColumn("told", none)
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash")]
    words = docs.select(*key, text.alias("__text"))
    hits = words.select("__id", "__hash", F.explode(_terms(F.col("__text"))).alias("term")).join(bounded_broadcast(flagged, broadcast_rows), "term")
    hits = hits.groupBy("__id", "__hash").agg(F.collect_set(F.struct("term", F.struct("disclosure", "kind").alias("level"))).alias("hits"))
    hits = stage_table(hits, "hits")
    keyed = found.withColumn("__id", F.col(id_col)).withColumn("__hash", F.xxhash64(text_col)).alias("d")
    right = bounded_broadcast(hits, broadcast_rows).alias("h")
    joined = keyed.join(right, F.col("d.__id").eqNullSafe(F.col("h.__id")) & (F.col("d.__hash") == F.col("h.__hash")), "left").select("d.*", "h.hits").drop("__id", "__hash")
    pattern = _quoted(F.transform("hits", lambda h: h["term"]))
    spans = _positions(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1)))
    levels = F.map_from_entries("hits")

    def labelled(span: Column) -> Column:
        level = F.try_element_at(levels, F.lower(span["value"]))
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), F.coalesce(level["disclosure"], F.lit(remove_at)).alias("disclosure"), level["kind"].alias("kind"))

    told = F.transform(spans, labelled)
    return joined.withColumn("told", F.when(F.col("hits").isNotNull(), told).otherwise(none)).drop("hits")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", remove_at: float = 0.9, **options) -> DataFrame:
    """``docs`` with personal data replaced by ``[EMAIL]`` and the like.

    Disclosing terms go, or are generalised to the class of what they tell of
    (``[EMAIL TERM]``), by their disclosure.  Where spans
    overlap, the first one's placeholder stands for all.  Keeps the columns of
    ``docs``; ``chars_col``, where present, is counted anew for changed rows.
    Texts without spans, null and empty ones too, stay as they are.
    """
    packed = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__body"), F.struct("*").alias("__row"))
    found = find_personal_data(packed, "__doc", "__body", remove_at=remove_at, **options)
    names, hints = (F.array(*[F.lit(f"[{k.upper()}{more}]") for k in KINDS]) for more in ("", " TERM"))
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("put")))
    terms = F.transform("told", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= remove_at, F.lit("")).otherwise(F.element_at(hints, s["kind"] + 1)).alias("put")))
    spans = F.sort_array(F.concat(base, terms))
    text = F.col("__body")

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, s["put"])).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    out = found.select("__row", clean.alias("__clean"), (F.size(spans) > 0).alias("__changed"))
    kinds = {f.name: f.dataType for f in docs.schema}
    row = F.col("__row")
    return out.select(*[F.col("__clean").alias(c) if c == text_col else F.when(F.col("__changed"), F.length("__clean").cast(kinds[c])).otherwise(row[c]).alias(c) if c == chars_col else row[c].alias(c) for c in docs.columns])


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per row of ``docs``.

    ``base_sha256`` digests the pattern spans as ``kind:start:end``, joined by
    commas (by start, then kind as listed); ``spans`` has those and the terms'
    spans (kind ``term``), likewise.
    """
    found = find_personal_data(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    told = F.transform("told", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("found", _of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.sort_array(F.concat(base, told))).alias("spans"))
