"""Secret scan with Spark SQL functions only: three base patterns, and character Markov models for what they miss.

A transition model of random strings is trained on the values that the base patterns find in all texts, one of ordinary
identifiers on the distinct words outside base spans of all texts. Every token of eight characters and more outside the base spans is
a secret if the log-likelihood ratio of the two models is high enough, in total and per transition.

Texts are read three times: for base patterns, for the words, and for the tokens once the models are known. A
pattern's matches and the lengths of the pieces between them give all positions as running sums; base spans are blanked in
place, so that positions stay. Words are made distinct within tasks first, so a frequent word costs one row a task.
Null and empty texts have no spans. Repeated rows each get their row; columns other than doc_id and text are not read, and redaction
keeps them whatever their names. A very long text costs a few copies of itself and a short string per match. An empty table
gives an empty result. Without any labelled sample both models are uniform and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import same_row, settle, shared_table, spread

# The base patterns.
_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in _NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
HEX_LEAST, ACCESS_LEAST, VALUE_LEAST = 32, 16, 8
KINDS = ["assign", "access", "hex", "markov"]
#: Shorter hex runs are never spans; this only saves listing them, and a longer run is still matched whole.
_LONG_HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
_BASE = [ASSIGN, ACCESS, _LONG_HEX]
_LEAST = [VALUE_LEAST, ACCESS_LEAST, HEX_LEAST]
_TOKEN = "[A-Za-z0-9+/_-]{8,}={0,2}"
_WORD = "[A-Za-z0-9+/_-]{4,}={0,2}"
#: A found token's first and further characters in a marked text.
_FIRST, _NEXT = "\x01", "\x02"

#: Characters of the models, the part of random strings whose characters are all alike likely (the samples may be of one kind, such as
#: hex digits), what is added to each one's count, how many transitions the fallback weighs, and the least ratios of a secret.
ALPHABET = 66
UNIFORM = 0.5
SMOOTHING = 0.5
BACKOFF = 5.0
LEAST_TOTAL = 12.0
LEAST_MEAN = 0.5
REPLACEMENT = "[SECRET]"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """Lengths of the pieces around a pattern's matches, and the matches; null where there is none."""
    has = text.rlike(pattern)
    return F.when(has, F.transform(F.split(text, pattern, -1), F.length)), F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _replaced(text: Column, pattern: str, written) -> Column:
    """``text`` with every match of a pattern written anew."""
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.concat(gap, F.when(hit.isNull(), F.lit("")).otherwise(written(hit))),
    )
    return F.array_join(pieces, "")


def _outside(text: Column) -> Column:
    """``text`` with its base spans blanked, each kind judged on the text as it is; as long as ``text``."""
    has, blanked = [text.rlike(pattern) for pattern in _BASE], []
    for kind, pattern in enumerate(_BASE):
        blank = lambda hit, kind=kind: F.when(F.length(_value(F.lit(kind), hit)) >= _LEAST[kind], F.repeat(F.lit(" "), F.length(hit))).otherwise(hit)
        blanked.append(_replaced(text, pattern, blank))
    # Kinds may overlap in part: what any of them blanks is blank.
    both = lambda x, y: F.zip_with(x, y, lambda a, b: F.when(a == b, a).otherwise(F.lit(" ")))
    every = F.array_join(both(both(F.split(blanked[0], ""), F.split(blanked[1], "")), F.split(blanked[2], "")), "")
    several = (has[0] & has[1]) | (has[0] & has[2]) | (has[1] & has[2])
    blank = F.when(several, every).when(has[0], blanked[0]).when(has[1], blanked[1]).otherwise(blanked[2])
    return F.when(text.rlike("|".join(_BASE)), blank).otherwise(text)


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, k and each base pattern's pieces and matches, one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    columns = []
    for kind, pattern in zip(KINDS, _BASE):
        gaps, hits = _found(text, pattern)
        columns += [gaps.alias(f"{kind}_gaps"), hits.alias(f"{kind}_hits")]
    return shared_table(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), *columns))


def _random_matches(docs: DataFrame, model: dict[tuple[int, int], float]) -> DataFrame:
    """doc_id, k, and pieces and matches of the tokens that the models call random, one row per row with any."""
    outside = F.translate(_outside(F.col("text")), _FIRST + _NEXT, "  ")
    mark = lambda hit: F.when(_is_random(hit, model), F.concat(F.lit(_FIRST), F.repeat(F.lit(_NEXT), F.length(hit) - 1))).otherwise(hit)
    marked = _once(outside, lambda text: _replaced(text, _TOKEN, mark))
    found = _once(marked, lambda text: F.struct(*[c.alias(n) for n, c in zip(("gaps", "hits"), _found(text, f"{_FIRST}{_NEXT}*"))]))
    rows = docs.filter(F.col("text").rlike(_TOKEN)).select("doc_id", F.xxhash64("doc_id", "text").alias("k"), found.alias("found"))
    return shared_table(rows).select("doc_id", "k", F.col("found.gaps").alias("markov_gaps"), F.col("found.hits").alias("markov_hits")).filter("markov_hits is not null")


def _spans(matches: DataFrame) -> DataFrame:
    """doc_id, k, kind (its number), start, end and hit of the matches of all kinds in ``matches``, those of one row once."""
    parts = []
    for number, kind in enumerate(KINDS):
        if f"{kind}_hits" not in matches.columns:
            continue
        rows = matches.filter(f"{kind}_hits is not null").select("doc_id", "k", f"{kind}_gaps", f"{kind}_hits").dropDuplicates(["doc_id", "k"])
        pairs = F.arrays_zip(F.col(f"{kind}_gaps").alias("gap"), F.col(f"{kind}_hits").alias("hit"))
        parts.append(rows.select("doc_id", "k", F.lit(number).alias("kind"), F.posexplode(pairs).alias("place", "pair")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = rows.select("doc_id", "k", "kind", "place", F.col("pair.gap").alias("gap"), F.col("pair.hit").alias("hit")).filter("hit is not null")
    before = Window.partitionBy("doc_id", "k", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.length("hit")).over(before)
    return rows.select("doc_id", "k", "kind", (end - F.length("hit")).alias("start"), end.alias("end"), "hit")


def _value(kind: Column, hit: Column) -> Column:
    return F.when(kind == 0, F.regexp_extract(hit, ASSIGN, 1)).otherwise(hit)


def base_spans(spans: DataFrame) -> DataFrame:
    """The base kinds' spans that are long enough."""
    least = F.get(F.array(*[F.lit(n) for n in _LEAST]), F.col("kind"))
    return spans.withColumn("value", _value(F.col("kind"), F.col("hit"))).filter(F.length("value") >= least)


def labelled_samples(docs: DataFrame, base: DataFrame) -> DataFrame:
    """token, secret (boolean): the distinct values of all base spans, and the distinct words of all texts outside base spans.

    Distinct, so that a secret in very many copies does not pass for an ordinary word.
    """
    texts = docs.filter("text is not null").select(_outside(F.col("text")).alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("token"))
    return base.select(F.col("value").alias("token"), F.lit(True).alias("secret")).union(words.select("token", F.lit(False).alias("secret"))).distinct()


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c))


def train(samples: DataFrame) -> dict[tuple[int, int], float]:
    """Log ratio of each transition (codes of two ASCII characters), a table of 128 x 128."""
    tokens = samples.filter(F.length("token") > 1).groupBy("token", "secret").agg(F.count("*").alias("times"))
    codes = tokens.withColumn("codes", _codes(F.col("token")))
    n = F.size("codes") - 1
    steps = F.zip_with(F.slice("codes", F.lit(1), n), F.slice("codes", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = codes.select("secret", "times", F.explode(steps).alias("step")).filter("step.a < 128 and step.b < 128").groupBy("step.a", "step.b").agg(
        F.sum(F.when(F.col("secret"), F.col("times")).otherwise(0)).alias("random"), F.sum(F.when(F.col("secret"), 0).otherwise(F.col("times"))).alias("plain")
    )
    seen = {(r["a"], r["b"]): (r["random"], r["plain"]) for r in counts.collect()}
    # The tokens to judge are among the words: of each transition's words one is left out, as that may be the token itself.
    seen = {pair: (random, max(plain - 1, 0)) for pair, (random, plain) in seen.items()}
    logs: list[dict[tuple[int, int], float]] = []
    for label in (0, 1):
        after, next_, every = [0] * 128, [0] * 128, 0
        for (a, b), count in seen.items():
            after[a] += count[label]
            next_[b] += count[label]
            every += count[label]
        # A transition falls back on how often its second character follows any.
        share = [(n + SMOOTHING) / (every + SMOOTHING * ALPHABET) for n in next_]
        logs.append({(a, b): math.log((seen.get((a, b), (0, 0))[label] + BACKOFF * share[b]) / (after[a] + BACKOFF)) for a in range(128) for b in range(128)})
    any_ = UNIFORM / ALPHABET
    return {pair: math.log((1 - UNIFORM) * math.exp(logs[0][pair]) + any_) - logs[1][pair] for pair in logs[0]} if seen else {}


def ratio(token: Column, model: dict[tuple[int, int], float]) -> Column:
    """Log-likelihood ratio of a token's transitions, random string against ordinary identifier."""
    table = F.split(F.lit(",".join(f"{model.get((a, b), 0.0):.6g}" for a in range(128) for b in range(128))), ",").cast("array<double>")
    codes = _codes(token)
    n = F.size(codes) - 1
    steps = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(table, a * 128 + b))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def _is_random(token: Column, model: dict[tuple[int, int], float]) -> Column:
    return ratio(token, model) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_MEAN * (F.length(token) - 1))


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, matches): doc_id, k, kind, start, end of all secrets, once per distinct row; and the rows of ``docs``."""
    settle(docs.sparkSession)
    matches = _matches(docs)
    base = base_spans(shared_table(_spans(matches)))
    model = train(labelled_samples(docs, base))
    random = _spans(_random_matches(docs, model))
    columns = ["doc_id", "k", "kind", "start", "end"]
    return base.select(*columns).union(random.select(*columns)), matches


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, k, n_assign, n_access, n_hex, n_markov, base and spans (texts ``kind:start:end``), one row per row of ``docs``."""
    spans, matches = scan(docs)
    listed = spans.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    out = same_row(matches.select("doc_id", "k"), listed)
    spans_ = F.coalesce("all", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    count = lambda number: F.size(F.filter(spans_, lambda s: s["kind"] == number)).cast("long")
    return out.select(
        "doc_id", "k", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        _written(F.filter(spans_, lambda s: s["kind"] < 3)).alias("base"), _written(spans_).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all columns stay, and ``n_chars`` follows the text where there is one."""
    spans, _ = scan(docs)
    # Spans that overlap are replaced as one.
    order = Window.partitionBy("doc_id", "k").orderBy("start", "end")
    fresh = spans.withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.when(F.col("start") < F.col("reached"), 0).otherwise(1))
    blocks = fresh.withColumn("block", F.sum("new").over(order)).groupBy("doc_id", "k", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = blocks.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__doc"), F.col("k").alias("__k"), "__cuts")
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    joined = keyed.join(cuts, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__k")), "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.length("text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.col("text").substr((a + 1).cast("int"), (b - a).cast("int")))
    out = joined.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, REPLACEMENT)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
