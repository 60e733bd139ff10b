"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that
every match satisfies.  The index holds a posting (trigram, document) for each
trigram that any rule asks for; postings are brought together per document, the
queries are answered on them, and only the candidates of a rule are read with its
regular expression.  A rule without a mandatory trigram reads every document.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: the rules.  (name, pattern, group whose length counts, least length) ---
BASE_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
MORE_RULES = [
    ("github", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@", 0, 8),
]
RULES = BASE_RULES + MORE_RULES

#: Strings a part of a pattern may stand for are listed up to this number, then given up.
EXACT = 16


# A query is True (anything), a trigram, or ("and" | "or", [queries]).
def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(map(_frozen, parts)) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(map(_frozen, parts)))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _frozen(query):
    return query


def _of_strings(strings: list[str]) -> object:
    """What holds when one of ``strings`` is present: all its trigrams."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query every match of ``pattern`` satisfies, in lower case."""
    return _walk(re._parser.parse(pattern))


def _walk(nodes) -> object:
    """The query of a sequence: trigrams of its runs of listable parts, and of its inner groups."""
    found, run = [], [""]
    for op, arg in nodes:
        strings = _strings(op, arg)
        if strings is not None and len(run) * len(strings) <= EXACT:
            run = [a + b for a, b in product(run, strings)]
            continue
        found.append(_of_strings(run))
        run = strings if strings is not None else [""]
        if strings is None:
            found.append(_inner(op, arg))
    return _all([*found, _of_strings(run)])


def _strings(op, arg) -> list[str] | None:
    """The strings a node stands for, when they are few."""
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()]
    if name == "IN":
        out = []
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.append(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < EXACT:
                out += [chr(c).lower() for c in range(value[0], value[1] + 1)]
            else:
                return None
        out = sorted(set(out))
        return out if len(out) <= EXACT else None
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        each = [_sequence(b) for b in arg[1]]
        joined = None if None in each else sorted({s for e in each for s in e})
        return joined if joined is None or len(joined) <= EXACT else None
    if name == "MAX_REPEAT" and arg[0:2] == (0, 1):
        inner = _sequence(arg[2])
        return None if inner is None or len(inner) >= EXACT else sorted({"", *inner})
    return None


def _sequence(nodes) -> list[str] | None:
    out = [""]
    for op, arg in nodes:
        strings = _strings(op, arg)
        if strings is None or len(out) * len(strings) > EXACT:
            return None
        out = [a + b for a, b in product(out, strings)]
    return out


def _inner(op, arg) -> object:
    name = str(op)
    if name == "SUBPATTERN":
        return _walk(arg[3])
    if name == "BRANCH":
        return _any([_walk(b) for b in arg[1]])
    if name == "MAX_REPEAT" and arg[0] >= 1:
        return _walk(arg[2])
    return True


def _trigrams(query) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else sorted({t for q in query[1] for t in _trigrams(q)})


def _holds(query, has) -> Column:
    """A query as a condition; ``has`` gives the condition of one trigram."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, has) for q in query[1]])


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc_id) for each of ``trigrams`` a text holds, in lower case."""
    lower = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return lower.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: list[tuple]) -> DataFrame:
    """(doc_id, rules): for each document in the index, the names of the rules its postings satisfy."""
    queries = {name: trigram_query(pattern) for name, pattern, *_ in rules}
    known = sorted({t for q in queries.values() for t in _trigrams(q)})
    place = {t: (i // 60, 1 << (i % 60)) for i, t in enumerate(known)}
    number = F.array_position(F.array(*map(F.lit, known)), F.col("trigram")) - 1
    bits = [
        F.bit_or(F.when(F.floor(number / 60) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (number % 60).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in range((len(known) + 59) // 60)
    ]

    def has(trigram: str) -> Column:
        word, bit = place[trigram]
        return F.col(f"w{word}").bitwiseAND(F.lit(bit)) != 0

    chosen = [F.when(_holds(q, has), F.lit(name)) for name, q in queries.items() if q is not True]
    return index.groupBy("doc_id").agg(*bits).select("doc_id", F.array_compact(F.array(*chosen)).alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """The spans (start, kind, end) of one rule: lengths of matches and of the text between them, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    sizes = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length).alias("gap"),
        F.transform(found, F.length).alias("size"),
        F.transform(counted, F.length).alias("counted"),
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["counted"] >= least, F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    return F.aggregate(sizes, first, step)["out"]


def scan(docs: DataFrame, rules: list[tuple] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a column ``spans``: array of (start, kind, end), in code points, end exclusive.

    ``kind`` is the place of the rule in ``rules``; spans are in order of start, then
    kind.  A null text is read as an empty one and has no spans; rows that share an
    id (or have none) share their postings, which only adds candidates, since every
    candidate is verified; repeated rows stay repeated.  A column named ``spans`` is replaced.
    """
    queries = {name: trigram_query(pattern) for name, pattern, *_ in rules}
    wanted = sorted({t for q in queries.values() for t in _trigrams(q)})
    docs = docs.drop("spans")
    hits = candidates(postings(docs, wanted, doc_id, text), rules).select(F.col("doc_id").alias("_carryover_hit"), F.col("rules").alias("_carryover_rules"))
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col("_carryover_hit")), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    each = []
    for k, (name, pattern, group, least) in enumerate(rules):
        chosen = F.array_contains(F.coalesce("_carryover_rules", F.expr("cast(array() as array<string>)")), name) if queries[name] is not True else F.lit(True)
        each.append(F.when(chosen & F.regexp_like(body, F.lit(pattern)), _spans(body, k, pattern, group, least)).otherwise(none))
    return joined.withColumn("spans", F.array_sort(F.concat(*each))).drop("_carryover_hit", "_carryover_rules")


def written(spans: Column, rules: list[tuple] = RULES) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: list[tuple] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mask``; overlapping spans by one.

    ``n_chars`` follows the new text; a null text stays null, an empty one empty, repeated rows
    stay, and other columns stay, one named ``spans`` too.
    """
    columns = docs.columns
    own = {c: f"_carryover_own_{c}" for c in columns if c.lower() == "spans"}
    found = scan(docs.withColumnsRenamed(own), rules)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], kept, F.lit(mask))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate("spans", first, step, lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    changed = F.size("spans") > 0
    # the length is taken of the finished column, not of a second copy of its expression
    new = found.withColumn("text", F.when(changed, masked).otherwise(F.col("text")))
    return new.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("spans").withColumnsRenamed({v: k for k, v in own.items()}).select(*columns)
