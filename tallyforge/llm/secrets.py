"""Secret scans with Spark SQL functions only.

Three patterns give the base spans: assignments, access keys and long hex
strings. Besides, every run of 20 or more characters of the base64 alphabets
is put to a battery of randomness tests under its inferred encoding (hex,
base32 or base64): chi-squared uniformity over the alphabet, runs above and
below its middle, and serial correlation of neighbouring symbols. Fisher's rule
combines the three into one p-value for "this is random".

Ordinary strings crowd near zero, random ones spread evenly over 0 to 1, so in
each stratum of encoding and length the strings above the highest cut tell how
many random ones lie above any lower cut; the rest above that cut are false discoveries. The
cut of a stratum is the least one at which their share stays below the limit,
which makes the scan stricter where strings are too short to tell apart. A
stratum of few random strings takes in the neighbouring lengths of its encoding
until they show enough; where all lengths together don't, their counts decide,
and at the strictest cut where nothing lies above it. So every candidate is judged.

Defined results: a null text is empty and has no span; a null id stays null;
repeated rows get equal results; spans of one start come in the order of their
kinds; a very long text is scanned whole; an empty table gives an empty result;
other columns are ignored. Offsets count code points, and ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Tables

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A pattern of a least length finds the same spans as an open one whose short matches are dropped: the runs are maximal.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 6
#: Share of false discoveries that a stratum may have, and the cuts that are tried.
FALSE_DISCOVERIES = 0.05
CUTS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2)
#: Random strings that a stratum must show to have a cut without its neighbours.
LEAST_EVIDENCE = 3

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

SPAN = "array<struct<start:int,end:int,tok:string>>"


def _located(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds for each name an array of struct(start, end, tok) of the pattern's matches in `_text`.

    The lengths of the pieces between the matches and of the matches
    themselves, summed up, are the offsets. Matches and pieces are columns of
    projections of their own, so that each pattern scans a text once, and once
    more to split the few texts that have a match.
    """
    out = docs.withColumns({f"_m_{k}": F.regexp_extract_all("_text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    out = out.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", p, -1)) for k, p in patterns.items()})
    empty = F.array().cast(SPAN)

    def spans(name: str) -> Column:
        found, gap = F.col(f"_m_{name}"), F.col(f"_g_{name}")

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gap[i])
            end = start + F.length(found[i])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), found[i].alias("tok")))).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        folded = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda acc: acc["out"])
        return F.when(F.size(found) > 0, folded).otherwise(empty)

    out = out.withColumns({f"_s_{k}": spans(k) for k in patterns})
    return out.drop(*[f"_{x}_{k}" for x in "mg" for k in patterns])


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic form that is right to 2e-4."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _battery(tok: Column) -> Column:
    """struct(enc, stratum, p): inferred encoding, encoding with length class, and the combined p-value."""
    enc = F.when(tok.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(tok.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")

    def tested(name: str) -> Column:
        alphabet = _ALPHABETS[name]
        size = len(alphabet)
        plain = F.lower(tok) if name == "hex" else F.translate(tok, "-_", "+/")
        n = F.length(plain).cast("double")
        squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(plain, c, F.lit(""))), F.lit(2.0)))
        chi = squares * size / n - n
        df = float(size - 1)
        uniform = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
        codes = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double") - 1)
        codes = F.slice(codes, F.lit(1), F.length(plain))

        def battery(v: Column) -> Column:
            pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            half = (size - 1) / 2
            above = F.size(F.filter(v, lambda x: x > half)).cast("double")
            below = n - above
            runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] > half) != (p["b"] > half)))
            mean = 2 * above * below / n + 1
            spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.01)))
            by_runs = 2 * _upper_tail(F.abs(runs - mean) / spread)
            deviation = lambda x: x - half
            product = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + deviation(p["a"]) * deviation(p["b"]))
            variance = (size * size - 1) / 12
            serial = 2 * _upper_tail(F.abs(product) / (variance * F.sqrt(n - 1)))
            least = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))
            x = -F.log(least(uniform)) - F.log(least(by_runs)) - F.log(least(serial))
            return F.exp(-x) * (1 + x + x * x / 2)

        return F.transform(F.array(codes), battery)[0]

    p = F.when(enc == "hex", tested("hex")).when(enc == "base32", tested("base32")).otherwise(tested("base64"))
    length_class = F.floor(2 * F.log2(F.length(tok) / F.lit(20.0))).cast("int")
    return F.struct(F.concat_ws("/", enc, length_class.cast("string")).alias("stratum"), p.alias("p"))


def discovery_cuts(found: DataFrame, limit: float = FALSE_DISCOVERIES) -> dict[str, float]:
    """The cut of each stratum, from all p-values of the corpus.

    `found` has a column `candidates`. The sums come back as one row for each
    stratum: three encodings times the half octaves of length, a few dozen.
    """
    each = found.select(F.explode("candidates.t").alias("t")).select("t.stratum", "t.p")
    counts = each.groupBy("stratum").agg(*[F.sum((F.col("p") >= c).cast("long")).alias(f"c{k}") for k, c in enumerate(CUTS)])
    strata: dict[str, dict[int, list[int]]] = {}
    for row in counts.collect():
        enc, length = row.stratum.split("/")
        strata.setdefault(enc, {})[int(length)] = [row[f"c{k}"] for k in range(len(CUTS))]
    top, cuts = CUTS[-1], {}
    for enc, lengths in strata.items():
        for length in lengths:
            for reach in sorted({abs(other - length) for other in lengths}):
                above = [sum(column) for column in zip(*[c for other, c in lengths.items() if abs(other - length) <= reach], strict=True)]
                random = above[-1] / (1 - top)
                if random >= LEAST_EVIDENCE:
                    break
            random += 1.64 * (random * top / (1 - top)) ** 0.5  # the count's own sampling error
            fits = (cut for cut, n in zip(CUTS, above, strict=True) if n and 1 - random * (1 - cut) / n <= limit)
            cuts[f"{enc}/{length}"] = next(fits, top)
    return cuts


def _labelled(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_found(docs: DataFrame) -> DataFrame:
    """Adds `assign`, `access` and `hex`, arrays of struct(start, rank, end), and `candidates`."""
    found = _located(docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))), {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "cand": CANDIDATE})
    assigned = F.filter("_s_assign", lambda s: F.length(F.regexp_extract(s["tok"], ASSIGN, 2)) >= LEAST_VALUE)
    tested = F.transform("_s_cand", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _battery(c["tok"]).alias("t")))
    out = found.withColumns({"assign": _labelled(assigned, 0), "access": _labelled(F.col("_s_access"), 1), "hex": _labelled(F.col("_s_hex"), 2), "candidates": tested})
    return out.drop("_text", *[f"_s_{k}" for k in ("assign", "access", "hex", "cand")])


def _with_spans(found: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """Adds `base` and `spans`, arrays of struct(start, rank, end) in order."""
    base = F.array_sort(F.concat("assign", "access", "hex"))
    out = found.withColumn("base", base)
    if not cuts:
        return out.withColumn("spans", F.col("base"))
    cut = F.create_map(*[F.lit(x) for item in sorted(cuts.items()) for x in item])
    random = F.filter(
        "candidates",
        lambda c: F.coalesce(c["t"]["p"] >= F.try_element_at(cut, c["t"]["stratum"]), F.lit(False)) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return out.withColumn("spans", F.array_sort(F.concat("base", _labelled(random, 3))))


def secret_spans(docs: DataFrame, limit: float = FALSE_DISCOVERIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = Tables(docs.sparkSession).keep(_with_found(rows).drop("text"), "found")
    out = _with_spans(found, discovery_cuts(found, limit))
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", limit: float = FALSE_DISCOVERIES) -> DataFrame:
    """The documents with `mark` in place of every span, overlapping ones as one; n_chars, where present, follows."""
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")
    # Rows may share their id, so they are written with what was found in them: the battery runs once.
    found = Tables(docs.sparkSession).keep(_with_found(inner).drop("text").select("_row", "assign", "access", "hex", "candidates"), "found")
    spans = _with_spans(found, discovery_cuts(found, limit))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), wider).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), merge)
    clean = F.aggregate(F.reverse(merged), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["end"] + 1, F.length(t))))
    hit = F.size("spans") > 0
    changed = {"text": F.when(hit, F.col("_clean")).otherwise(F.col("_row.text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(hit, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return spans.withColumn("_clean", F.when(hit, clean)).select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])
