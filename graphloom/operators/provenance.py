"""Why a fact holds: every fact of a closure with its least proofs, carried along by the rules that derive it.

A proof is the set of asserted facts and axioms a derivation rests on, as sorted texts. A rule's conclusion has the union of
its premises' proofs and its own axiom; of a fact's proofs the `most` least are kept, by number of statements, then by name,
and none that contains another. Rounds join new proofs with those kept (semi-naive) until no fact gains a proof.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialise import discard, saved, sweep
from .closure import Terminology
from .reasoner import prepared, table_of
from .rules import STATE, TYPE, Rules, pick

_FACT = ["g", "s", "k", "o"]
#: Proofs of a fact that one round looks at, in multiples of those kept: room for ones that contain others.
ROOM = 4


def _key_text() -> Column:
    """An asserted row as text: 's p o', types as 'i rdf:type c'."""
    typed = F.concat(F.col("s"), F.lit(" rdf:type "), F.expr(f"substring(k, {len(TYPE) + 1})"))
    return F.when(F.col("k").startswith(TYPE), typed).otherwise(F.concat_ws(" ", "s", "k", "o"))


def _joined(*proofs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*proofs)))


def _least(proofs: Column, most: int) -> Column:
    """Of an array of proofs the `most` least of those that contain no other, in order; a bounded number is looked at."""
    by_size = F.transform(F.array_sort(F.transform(F.array_distinct(proofs), lambda p: F.struct(F.size(p).alias("n"), p.alias("p")))), lambda x: x["p"])
    minimal = lambda some: F.filter(some, lambda p: ~F.exists(some, lambda q: (q != p) & (F.size(F.array_except(q, p)) == 0)))
    # as an element of an array, so that the sorted proofs are worked out once and not for each proof
    least = F.flatten(F.transform(F.array(F.slice(by_size, 1, ROOM * most)), minimal))
    return F.when(F.size(proofs) <= 1, proofs).otherwise(F.slice(least, 1, most))


def _consequences(one: list, k0: str, room: int) -> list[tuple[str, str, list[list[str]]]]:
    """(k1, ends, ways): what rules of one premise, one after the other, make of a fact of k0; ways: the least sets of axioms
    that lead there, at most `room`, none containing another. The fact itself is left out, whatever leads back to it."""
    own = (k0, "ss" if k0.startswith(TYPE) else "so")
    found: dict[tuple[str, str], list[frozenset]] = {own: [frozenset()]}
    order = lambda w: (len(w), sorted(w))
    todo = [(own, frozenset())]
    while todo:
        at, way = todo.pop()
        if way not in found[at]:  # a lesser one took its place
            continue
        for k1, then, why in one.get(at[0], ()):
            to, w = (k1, pick(at[1], then)), way | frozenset(why)
            have = found.setdefault(to, [])
            if any(x <= w for x in have):
                continue
            have = sorted([*(x for x in have if not w <= x), w], key=order)[:room]
            found[to] = have
            if w in have:
                todo.append((to, w))
    del found[own]
    return [(k1, ends, [sorted(w) for w in ways]) for (k1, ends), ways in sorted(found.items())]


def _full(k0: str, ends: str) -> bool:
    """Whether a conclusion tells which fact of k0 it is of."""
    return ends in ("so", "os") or k0.startswith(TYPE)


class _Part:
    """The facts of one round with their new proofs, a row a fact: (g, s, k, o, proofs).

    `raw` and `merged` are tables; what follows from raw rows alone, one fact from one, is no table but worked out from them
    whenever it is read. Of conclusions on one end of a fact, each end has its least facts in `ends` ('ss', 'oo').
    """

    def __init__(self, raw: DataFrame, hidden: set[str], single: dict[str, tuple], ends: dict[str, DataFrame], merged: DataFrame | None, most: int):
        self.raw, self.hidden, self.single, self.ends, self.merged, self.most = raw, hidden, single, ends, merged, most

    def rows(self, keys: set[str] | None = None) -> DataFrame:
        only = lambda df: df if keys is None else df.where(F.col("k").isin(sorted(keys)))
        out = [only(self.raw.where(~F.col("k").isin(sorted(self.hidden))) if self.hidden else self.raw)]
        rules = [x for k1, x in self.single.items() if keys is None or k1 in keys]
        out += _followed(rules, self.raw, self.ends, self.most)
        if self.merged is not None:
            out.append(only(self.merged))
        return reduce(DataFrame.unionByName, out)


def _followed(rules: list[tuple], raw: DataFrame, ends: dict[str, DataFrame], most: int) -> list[DataFrame]:
    """What rules (k0, k1, ends, ways) make of raw facts, and of their ends."""
    out = []
    for form in ("", "ss", "oo"):
        some = [(k0, k1, e == "os", ways) for k0, k1, e, ways in rules if form == ("" if _full(k0, e) else e)]
        if some:
            table = table_of(raw.sparkSession, some, "k0 string, k1 string, turned boolean, ways array<array<string>>")
            every = F.flatten(F.transform("ways", lambda w: F.transform("proofs", lambda p: _joined(p, w))))
            end = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
            j = (ends[form] if form else raw).join(table, F.col("k") == F.col("k0"))
            j = j.select("g", end("s", "o").alias("s"), F.col("k1").alias("k"), end("o", "s").alias("o"), every.alias("proofs"))
            out.append(j.withColumn("proofs", _least(F.col("proofs"), most)))
    return out


def _kept(new: DataFrame, old: DataFrame | None, most: int) -> DataFrame:
    """Of new proofs (g, s, k, o, proofs) those among a fact's least, old ones counted, that contain none of them. Rows are
    cut to each fact's least before they are shuffled, once."""
    flat = lambda df, was: df.select(*_FACT, F.explode("proofs").alias("proof"), F.lit(was).alias("was"))
    rows = flat(new, False)
    if old is not None:
        rows = rows.unionByName(flat(old, True))
    by = Window.partitionBy(*_FACT).orderBy(F.size("proof"), "proof")
    rows = rows.withColumn("rank", F.dense_rank().over(by)).where(F.col("rank") <= ROOM * most)
    sets = rows.groupBy(*_FACT).agg(F.collect_set(F.when(~F.col("was"), F.col("proof"))).alias("new"), F.collect_set(F.when(F.col("was"), F.col("proof"))).alias("had"))
    if old is None:
        return sets.select(*_FACT, _least(F.col("new"), most).alias("proofs"))
    kept = sets.select(*_FACT, "had", _least(F.array_union("new", "had"), most).alias("least"))
    return kept.select(*_FACT, F.array_except("least", "had").alias("proofs")).where(F.size("proofs") > 0)


class _Steps:
    def __init__(self, spark: SparkSession, r: Rules, most: int):
        make = lambda rows, schema: table_of(spark, [(*x[:-1], list(x[-1])) for x in dict.fromkeys(rows)], schema + ", why array<string>") if rows else None
        self.two = make(r.two, "ka string, kb string, k1 string, ends string")
        self.value, self.gives, self.loops = make(r.value, "k0 string, v string, k1 string"), make(r.gives, "k0 string, k1 string, v string"), make(r.loops, "k0 string, k1 string")
        self.left, self.right = {x[0] for x in r.two}, {x[1] for x in r.two}
        self.plain = {x[0] for part in (r.value, r.gives, r.loops) for x in part}
        self.rules = r
        self.known, self.most, self.one = r.keys() | {x[2] for x in [*r.two, *r.value]} | {x[1] for x in [*r.one, *r.gives, *r.loops]}, most, {}
        for k0, k1, ends, why in r.one:
            self.one.setdefault(k0, []).append((k1, ends, why))

    def part(self, raw: DataFrame, old: list[tuple[_Part, set[str]]]) -> tuple[_Part, set[str]]:
        """The round of raw facts: them and what rules of one premise make of them; and the keys that it may hold."""
        most = self.most
        present = {x.k for x in raw.where(F.col("k").isin(sorted(self.known))).select("k").distinct().collect()}
        rules = [(k0, k1, ends, ways) for k0 in sorted(present) for k1, ends, ways in _consequences(self.one, k0, ROOM * most)]
        ends = {}
        for form, c in (("ss", "s"), ("oo", "o")):
            if used := sorted({k0 for k0, _, e, _ in rules if not _full(k0, e) and e == form}):
                facts = raw.where(F.col("k").isin(used)).select("g", F.col(c).alias("s"), "k", F.col(c).alias("o"), "proofs")
                ends[form] = saved(_kept(facts, None, ROOM * most), "proofs-ends")
        before = {k for _, keys in old for k in keys}
        sources: dict[str, list] = {}
        for x in rules:
            sources.setdefault(x[1], []).append(x)
        single = {k1: x[0] for k1, x in sources.items() if len(x) == 1 and k1 not in present and k1 not in before}
        several = {k1 for k1 in sources if k1 not in single}
        merged = None
        if several:
            new = [raw.where(F.col("k").isin(sorted(several & present)))] if several & present else []
            new += _followed([x for x in rules if x[1] in several], raw, ends, most)
            again = [p.rows(keys & several) for p, keys in old if keys & several]
            merged = saved(_kept(reduce(DataFrame.unionByName, new), reduce(DataFrame.unionByName, again) if again else None, most), "proofs-merged")
        sweep(raw.sparkSession)
        return _Part(raw, several & present, single, ends, merged, most), present | set(sources)

    def heads(self, held: set[str]) -> set[str]:
        """Keys that `derived` may conclude from facts of the keys held."""
        r = self.rules
        out = {x[2] for x in r.two if x[0] in held and x[1] in held} | {x[2] for x in r.value if x[0] in held}
        return out | {x[1] for x in [*r.gives, *r.loops] if x[0] in held}

    def derived(self, parts: list[tuple[_Part, set[str]]]) -> DataFrame | None:
        """What rules of more premises make of the last part and all parts."""
        out, proof = [], F.transform("proofs", lambda p: _joined(p, F.col("why"))).alias("proofs")
        last, held = parts[-1]
        on = F.col("k") == F.col("k0")
        delta = last.rows(held & self.plain) if held & self.plain else None
        if delta is not None and self.value is not None:
            out.append(delta.join(self.value, on & (F.col("o") == F.col("v"))).select("g", "s", F.col("k1").alias("k"), F.col("s").alias("o"), proof))
        if delta is not None and self.gives is not None:
            out.append(delta.join(self.gives, on).select("g", "s", F.col("k1").alias("k"), F.col("v").alias("o"), proof))
        if delta is not None and self.loops is not None:
            out.append(delta.where("s = o").join(self.loops, on).select("g", "s", F.col("k1").alias("k"), "o", proof))
        rows = lambda some, keys: [p.rows(k & keys) for p, k in some if k & keys]
        # the last part before any part, and the parts before it before the last
        for first, second in ((parts[-1:], parts), (parts[:-1], parts[-1:])):
            a, b = rows(first, self.left), rows(second, self.right)
            if self.two is None or not a or not b:
                continue
            a, b = reduce(DataFrame.unionByName, a), reduce(DataFrame.unionByName, b)
            a = a.join(self.two, F.col("k") == F.col("ka")).select("g", F.col("s").alias("a"), F.col("o").alias("m"), "proofs", "kb", "k1", "ends", "why")
            b = b.select(F.col("g").alias("g2"), F.col("s").alias("m2"), F.col("k").alias("kk"), F.col("o").alias("b"), F.col("proofs").alias("proofs2"))
            j = a.join(b, (F.col("g") == F.col("g2")) & (F.col("m") == F.col("m2")) & (F.col("kb") == F.col("kk")))
            s, o = F.when(F.col("ends") == "bb", F.col("b")).otherwise(F.col("a")), F.when(F.col("ends") == "aa", F.col("a")).otherwise(F.col("b"))
            both = F.flatten(F.transform("proofs", lambda p: F.transform("proofs2", lambda q: _joined(p, q, F.col("why")))))
            out.append(j.select("g", s.alias("s"), F.col("k1").alias("k"), o.alias("o"), both.alias("proofs")))
        return reduce(DataFrame.unionByName, out) if out else None


def by_fact(facts: DataFrame, types: DataFrame, t: Terminology | Rules, most: int = 3, strict: bool = True) -> DataFrame:
    """(g, s, p, o, proofs) of every asserted or entailed fact, a row each, types with p 'rdf:type': its `most` least proofs,
    least first. See `proofs`."""
    spark = facts.sparkSession
    r = t if isinstance(t, Rules) else prepared(spark, t, strict)
    steps = _Steps(spark, r, most)
    a = facts.select("g", "s", F.col("p").alias("k"), "o")
    rows = a.unionByName(types.select("g", F.col("i").alias("s"), F.concat(F.lit(TYPE), "c").alias("k"), F.col("i").alias("o")))
    rows = saved(rows.where("g IS NOT NULL AND s IS NOT NULL AND k IS NOT NULL AND o IS NOT NULL").distinct(), "proofs")
    sweep(spark)
    parts = [steps.part(rows.withColumn("proofs", F.array(F.array(_key_text()))), [])]
    while (new := steps.derived(parts)) is not None:
        heads = steps.heads({k for _, keys in parts for k in keys})
        again = [p.rows(keys & heads) for p, keys in parts if keys & heads]
        raw = saved(_kept(new, reduce(DataFrame.unionByName, again) if again else None, most), "proofs-new")
        if raw.isEmpty():
            discard(raw)
            break
        parts.append(steps.part(raw, parts))
    sweep(spark)
    times: dict[str, int] = {}
    for _, keys in parts:
        for k in keys:
            times[k] = times.get(k, 0) + 1
    often = {k for k, n in times.items() if n > 1}
    # facts of keys that one round alone holds are done; others may have proofs of several rounds
    once = [p.rows() if not often else p.rows().where(~F.col("k").isin(sorted(often))) for p, _ in parts]
    if often:
        once.append(_kept(reduce(DataFrame.unionByName, [p.rows(keys & often) for p, keys in parts if keys & often]), None, most))
    found = reduce(DataFrame.unionByName, once).where(~(F.col("k").startswith(STATE) | F.col("k").startswith(TYPE + "nested ")))
    typed = F.col("k").startswith(TYPE)
    return found.select(
        "g", "s", F.when(typed, F.lit("rdf:type")).otherwise(F.col("k")).alias("p"), F.when(typed, F.expr(f"substring(k, {len(TYPE) + 1})")).otherwise(F.col("o")).alias("o"), "proofs")


def proofs(facts: DataFrame, types: DataFrame, t: Terminology | Rules, most: int = 3, strict: bool = True) -> DataFrame:
    """(g, s, p, o, proof, size, rank) of every asserted or entailed fact, types with p 'rdf:type': its `most` least proofs.

    facts (g, s, p, o) and types (g, i, c); t as for `reasoner.closure`. Names that are one by equality are not merged here;
    use it on a closure's facts where they matter. A proof of least size is always among those kept; which others are follows
    the order by size and name among unions of kept proofs.
    """
    return spread(by_fact(facts, types, t, most, strict))


def spread(found: DataFrame) -> DataFrame:
    """Rows of `by_fact` as a row a proof, (g, s, p, o, proof, size, rank)."""
    each = found.select("g", "s", "p", "o", F.posexplode("proofs").alias("rank", "proof"))
    return each.select("g", "s", "p", "o", "proof", F.size("proof").alias("size"), (F.col("rank") + 1).alias("rank"))


#: Axiom kinds by what a statement's text says, tried in this order; others are facts.
_KINDS = [
    (" SubClassOf ", "SubClassOf"), (" rdfs:subPropertyOf ", "SubObjectPropertyOf"), (" owl:equivalentClass ", "EquivalentClasses"), (" owl:equivalentProperty ", "EquivalentObjectProperties"),
    (" owl:inverseOf ", "InverseObjectProperties"), ("TransitiveObjectProperty(", "TransitiveObjectProperty"), ("SymmetricObjectProperty(", "SymmetricObjectProperty"), ("FunctionalObjectProperty(", "FunctionalObjectProperty"),
    ("domain(", "ObjectPropertyDomain"), ("range(", "ObjectPropertyRange"), (" → ", "SubPropertyChainOf"), (" intersectionOf ", "EquivalentClasses"), (" unionOf ", "EquivalentClasses"),
    (" someValuesFrom ", "EquivalentClasses"), (" allValuesFrom ", "SubClassOf"), (" rdf:type ", "ClassAssertion"),
]


def as_paths(found: DataFrame) -> DataFrame:
    """Proofs as explanation paths, as the finders of `paths` give them: asserted facts first, then axioms by name."""
    is_axiom = lambda x: reduce(lambda a, b: a | b, (x.contains(w) for w, k in _KINDS if k != "ClassAssertion"))

    def kind_of(x):
        out = F
        for word, name in _KINDS:
            out = out.when(x.contains(word), F.lit(name))
        return out.otherwise(F.lit("ObjectPropertyAssertion"))

    ordered = F.concat(F.filter("proof", lambda x: ~is_axiom(x)), F.filter("proof", is_axiom))
    out = found.withColumn("justifications", ordered)
    return out.select(
        "s", "p", "o", F.lit("proof").alias("finder"), F.when(F.col("size") == 1, "DIRECT_ASSERTION").otherwise("DERIVATION").alias("type"),
        F.transform("justifications", lambda x: F.struct(kind_of(x).alias("kind"), x.alias("text"))).alias("axioms"), "justifications",
        F.array_join("justifications", " and ").alias("description"), F.col("size").alias("complexity"))
