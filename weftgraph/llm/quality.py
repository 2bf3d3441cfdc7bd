"""Quality rules as weak supervision, in DataFrame and SQL functions alone.

Each rule looks at the counts of a text and votes good (1), votes bad (-1) or abstains
(0). Expectation-maximisation over the counts of the vote patterns estimates how often
each rule is right on good and on bad texts; a text is kept where its posterior
probability of being good reaches ``KEEP_AT``. A rule that often contradicts the others
loses its say, and several weak doubts add up, so neither one bad vote nor none decides.

Rules of one family look at the same thing and err together. Their votes aren't
independent, so each counts with the power one over the root of the family's size.

There are at most 3 ** rules patterns, so the fit is one row of bounded size, whatever the
input.

Rows: one result for each input row, repeated rows alike. A null or empty text has no
words, fails the base rules and isn't kept. An empty table gives no row. Extra columns
of any name stay where ``kept_documents`` is used; clashing ones are prefixed inside.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Words are runs of anything but these.
WHITE = r"[\\x20\\x09-\\x0D]"
NOT_WHITE = r"[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WHITE_CHARS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_AT = 0.5
EM_STEPS = 40
#: Weight of the starting beliefs, in documents, and the bounds of accuracies.
PRIOR_WEIGHT = 50.0
PRIOR_GOOD = 0.8
#: Chance that a vote is right on good and on bad texts: beliefs to start with, and bounds,
#: which only say that a rule's good votes aren't perverse. Fixed beforehand, not fitted to labels.
ACCURACY_GOOD, BOUNDS_GOOD = 0.97, (0.5, 0.999)
ACCURACY_BAD, BOUNDS_BAD = 0.3, (0.05, 0.999)

#: name, family, vote good where, vote bad where; over the columns of ``metrics``.
#: Limits of bad votes are those of published filters for web text (50 words; mean word
#: length 3 to 10; a symbol for ten words; 80 % letters; 30 % of lines or 18 % of words in
#: repetitions; lines of five words; terminal marks); good votes ask for half of that or less.
RULES = (
    ("length", "shape", "n_words >= 100", "n_words < 50"),
    ("sentences", "shape", "40 * n_ends >= n_words", "200 * n_ends < n_words"),
    ("line_size", "shape", "n_words >= 10 * n_lines", "n_words < 5 * n_lines"),
    ("word_size", "words", "word_chars between 4 * n_words and 9 * n_words", "word_chars not between 3 * n_words and 10 * n_words"),
    ("digits", "words", "20 * n_digits <= word_chars", "20 * n_digits > 3 * word_chars"),
    ("capitals", "words", "8 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    ("symbols", "characters", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("letters", "characters", "10 * n_other <= word_chars", "5 * n_other > word_chars"),
    ("density", "characters", "50 * n_symbols <= word_chars", "10 * n_symbols > word_chars"),
    ("lines", "repetition", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "repetition", "100 * n_repeat_words <= 6 * n_words", "100 * n_repeat_words > 18 * n_words"),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_digits", "n_upper", "n_ends", "n_other")
_OWN = "_quality_"


def powers() -> list[float]:
    """The power of each rule's votes: one over the root of its family's size."""
    return [sum(y == x for _, y, _, _ in RULES) ** -0.5 for _, x, _, _ in RULES]


def with_metrics(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``docs`` with the counts of each text in columns ``_quality_*``.

    Three-word windows that may be found again are those whose hash (``hash_bits`` of it, less
    what the position needs), sorted with the position in one array of longs, stands beside an
    equal one. Their words, sorted, then tell which are: hashes never decide. No text leaves
    its row.
    """
    c = {k: _OWN + k for k in ("t", "w", "l", "b", "h", "s", "e", "d")}
    n = {k: _OWN + k for k in (*METRICS, *_MORE)}
    none = "cast(array() as array<bigint>)"
    out = docs.withColumn(c["t"], F.expr("coalesce(text, '')"))
    t = F.col(c["t"])

    def lacking(chars: str) -> F.Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")

    out = out.withColumns(
        {
            c["w"]: F.expr(f"filter(split({c['t']}, '{WHITE}+'), x -> x != '')"),
            c["l"]: F.expr(f"filter(split({c['t']}, '\\n'), x -> x rlike '{NOT_WHITE}')"),
            n["word_chars"]: (F.length(t) - lacking(WHITE_CHARS)).cast("long"),
            n["n_symbols"]: lacking(SYMBOLS),
            n["n_digits"]: lacking("0123456789"),
            n["n_upper"]: lacking("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            n["n_ends"]: lacking(".!?"),
            n["n_other"]: lacking("!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"),
        }
    )
    out = out.withColumns(
        {
            n["n_words"]: F.size(c["w"]).cast("long"),
            n["n_lines"]: F.size(c["l"]).cast("long"),
            n["n_dup_lines"]: (F.size(c["l"]) - F.size(F.array_distinct(c["l"]))).cast("long"),
            c["b"]: F.length(F.bin(F.size(c["w"]))),
        }
    )
    w, b, h, s, e, d = c["w"], c["b"], c["h"], c["s"], c["e"], c["d"]
    hashed = f"xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))"
    if hash_bits < 64:
        hashed = f"({hashed} & {(1 << hash_bits) - 1}L)"
    out = out.withColumn(
        h,
        F.expr(
            f"if(size({w}) >= 3, transform(sequence(0, size({w}) - 3), i -> "
            f"shiftleft({hashed}, {b}) | cast(i as bigint)), {none})"
        ),
    )
    out = out.withColumn(s, F.sort_array(h))
    same = "coalesce(shiftrightunsigned(x, {b}) = shiftrightunsigned(get({s}, i {by} 1), {b}), false)"
    twice = " or ".join(same.format(b=b, s=s, by=by) for by in "-+")
    out = out.withColumn(
        e,
        F.expr(
            f"sort_array(transform(transform(filter({s}, (x, i) -> {twice}), x -> cast(x & (shiftleft(cast(1 as bigint), {b}) - 1) as int)), "
            f"i -> named_struct('words', concat_ws(' ', get({w}, i), get({w}, i + 1), get({w}, i + 2)), 'at', i)))"
        ),
    )
    again = " or ".join(f"coalesce(x.words = get({e}, i {by} 1).words, false)" for by in "-+")
    out = out.withColumn(d, F.expr(f"sort_array(transform(filter({e}, (x, i) -> {again}), x -> cast(x.at as bigint)))"))
    out = out.withColumn(
        n["n_repeat_words"],
        F.expr(
            f"aggregate(transform({d}, (x, i) -> least(3L, coalesce(get({d}, i + 1) - x, 3L))), 0L, (a, x) -> a + x)"
        ),
    )
    return out.drop(*c.values())


def _rule_sql(sql: str) -> str:
    return re.sub("|".join(map(r"\b{}\b".format, (*METRICS, *_MORE))), lambda m: _OWN + m[0], sql)


def with_votes(measured: DataFrame) -> DataFrame:
    """Adds ``_quality_pattern``: the votes as digits of a number to base 3."""
    votes = [f"(case when {_rule_sql(bad)} then 0 when {_rule_sql(good)} then 2 else 1 end)" for _, _, good, bad in RULES]
    pattern = " + ".join(f"{3**j} * {v}" for j, v in enumerate(votes))
    failed = (
        f"{_OWN}n_words < {MIN_WORDS} or "
        f"100 * {_OWN}n_repeat_words > {REPEAT_PERCENT} * {_OWN}n_words"
    )
    return measured.withColumns({_OWN + "pattern": F.expr(pattern), _OWN + "base_failed": F.expr(failed)})


def _em_sql() -> str:
    """One row's patterns ``ps`` (votes ``v``, documents ``n``) to the fitted state."""
    r = len(RULES)
    power = f"array({', '.join(f'{x!r}D' for x in powers())})"

    def likelihood(of: str, right: int) -> str:
        # an abstention says nothing
        return (
            f"aggregate(sequence(0, {r - 1}), 1D, (x, j) -> x * pow(case when get(p.v, j) = {right} then get({of}, j) "
            f"when get(p.v, j) = {-right} then 1 - get({of}, j) else 1D end, get({power}, j)))"
        )

    good, bad = likelihood("s.a", 1), likelihood("s.b", -1)
    posterior = f"transform(ps, p -> (s.pi * {good}) / (s.pi * {good} + (1 - s.pi) * {bad}))"

    def summed(of: str) -> str:
        return f"aggregate(sequence(0, size(ps) - 1), 0D, (x, k) -> x + {of})"

    def accuracy(weight: str, right: int, belief: float, bounds: tuple[float, float]) -> str:
        lo, hi = bounds
        hit = summed(f"if(get(get(ps, k).v, j) = {right}, get(ps, k).n * {weight}, 0D)")
        cast = summed(f"if(get(get(ps, k).v, j) != 0, get(ps, k).n * {weight}, 0D)")
        return (
            f"transform(sequence(0, {r - 1}), j -> least({hi}D, greatest({lo}D, "
            f"({hit} + {PRIOR_WEIGHT * belief}D) / ({cast} + {PRIOR_WEIGHT}D))))"
        )

    share = (
        f"({summed('get(ps, k).n * get(q, k)')} + {PRIOR_WEIGHT * PRIOR_GOOD}D) / "
        f"({summed('get(ps, k).n')} + {PRIOR_WEIGHT}D)"
    )
    # transform(array(x), q -> ...) binds x to a name
    step = (
        f"get(transform(array({posterior}), q -> named_struct('pi', {share}, "
        f"'a', {accuracy('get(q, k)', 1, ACCURACY_GOOD, BOUNDS_GOOD)}, "
        f"'b', {accuracy('(1 - get(q, k))', -1, ACCURACY_BAD, BOUNDS_BAD)})), 0)"
    )
    init = (
        f"named_struct('pi', {PRIOR_GOOD}D, 'a', array_repeat({ACCURACY_GOOD}D, {r}), "
        f"'b', array_repeat({ACCURACY_BAD}D, {r}))"
    )
    return (
        f"get(transform(array(aggregate(sequence(1, {EM_STEPS}), {init}, (s, i) -> {step})), "
        f"s -> named_struct('state', s, 'q', {posterior})), 0)"
    )


def fit(voted: DataFrame) -> DataFrame:
    """``_quality_pattern``, ``posterior``: at most 3 ** rules rows."""
    counts = voted.groupBy(_OWN + "pattern").agg(F.count("*").cast("double").alias("n"))
    r = len(RULES)
    votes = F.expr(f"transform(sequence(0, {r - 1}), j -> cast(floor({_OWN}pattern / pow(3, j)) % 3 - 1 as int))")
    one = counts.withColumn("v", votes).agg(
        F.array_sort(F.collect_list(F.struct(_OWN + "pattern", "v", "n"))).alias("ps")
    )
    fitted = one.filter("size(ps) > 0").withColumn("em", F.expr(_em_sql()))
    return fitted.select(F.posexplode("ps").alias("k", "p"), "em.q").select(
        F.col(f"p.{_OWN}pattern").alias(_OWN + "pattern"), F.get("q", F.col("k")).alias("posterior")
    )


def judge(voted: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``_quality_posterior`` and ``_quality_kept``; the model has a bounded number of rows."""
    known = model.withColumnRenamed("posterior", _OWN + "posterior")
    kept = ~F.col(_OWN + "base_failed") & (F.col(_OWN + "posterior") >= KEEP_AT)
    return voted.join(F.broadcast(known), _OWN + "pattern", "left").withColumn(
        _OWN + "kept", F.coalesce(kept, F.lit(False))
    )


def quality(docs: DataFrame) -> DataFrame:
    """Counts, base rules, posterior and verdict of each document."""
    voted = materialize(with_votes(with_metrics(docs.select("doc_id", "text"))).drop("text"), "quality")
    judged = judge(voted, fit(voted))
    return judged.select("doc_id", *(F.col(_OWN + k).alias(k) for k in (*METRICS, "base_failed", "kept", "posterior")))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The texts are counted once: they are written beside their patterns, read again once
    the model is fitted, and never shuffled.
    """
    voted = materialize(with_votes(with_metrics(docs)).select(*docs.columns, _OWN + "pattern", _OWN + "base_failed"), "quality-votes")
    model = materialize(fit(voted.select(_OWN + "pattern")), "quality-model")
    return judge(voted, model).filter(_OWN + "kept").select(docs.columns)
