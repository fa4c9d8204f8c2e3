"""A terminology as rules of one and two premises, class expressions of any depth flattened with fresh names.

Facts and types are one table (g, s, k, o): k is the property, or 'type ' and the class with s = o. Every rule then has one
of few forms, and every rule of two premises joins the object of its first with the subject of its second:

    one     k0(x, y) -> k1, ends picked by two letters: 'so', 'os' (turned), 'ss' (domain), 'oo' (range)
    two     ka(x, y), kb(y, z) -> k1, ends 'ab' (x, z: chains), 'aa' (x, x: some, and), 'bb' (z, z: all values)
    value   k0(x, v) -> k1(x, x)        gives   k0(x, x) -> k1(x, v)        loops   k0(x, x) -> k1(x, x)
    unique  members of a class have one value of a property (of a class): values are one     back  same, of subjects
    single  members of a class are the one named     never  two classes share no member

Chains of any length share their prefixes: a state, itself a key, stands for the facts that have read one, so a closure over
facts and states is the closure over (node, state) pairs of the automaton of all chains.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from .closure import STATE, Terminology, chain_steps, chain_steps_back

TYPE, THING = "type ", "owl:Thing"
_THINGS = {THING, "http://www.w3.org/2002/07/owl#Thing"}
_NOTHINGS = {"owl:Nothing", "http://www.w3.org/2002/07/owl#Nothing"}


class NotUnderstood(ValueError):
    """Axioms, or parts of them, that no rule here covers; `parts` lists (axiom, reason)."""

    def __init__(self, parts: list[tuple[str, str]]):
        super().__init__("not covered by rules: " + "; ".join(f"{a} ({why})" for a, why in parts))
        self.parts = parts


@dataclass
class Rules:
    one: list = field(default_factory=list)  # (k0, k1, ends, why)
    two: list = field(default_factory=list)  # (ka, kb, k1, ends, why)
    value: list = field(default_factory=list)  # (k0, v, k1, why)
    gives: list = field(default_factory=list)  # (k0, k1, v, why)
    loops: list = field(default_factory=list)  # (k0, k1, why)
    nominal: list = field(default_factory=list)  # (v, k1, why)
    unique: list = field(default_factory=list)  # (class key or '', property, class key or '', why)
    back: list = field(default_factory=list)  # (property, why)
    single: list = field(default_factory=list)  # (class key, v, why)
    never: list = field(default_factory=list)  # (class key, class key, why)
    apart: list = field(default_factory=list)  # (property, property, why): no pair of ends in both
    exists: list = field(default_factory=list)  # (class key, property, class key, why): anonymous successors
    left_out: list = field(default_factory=list)  # (axiom, reason)
    halves: list = field(default_factory=list)  # (axiom, reason): the conclusions of definitions that need case distinctions

    def keys(self) -> set[str]:
        """Keys that some premise names: facts of other keys yield nothing."""
        out = {r[0] for part in (self.one, self.value, self.gives, self.loops) for r in part}
        out |= {k for r in self.two for k in r[:2]} | {k for r in self.unique for k in r[:3] if k} | {r[0] for r in [*self.back, *self.single, *self.exists]}
        return out | {k for r in [*self.never, *self.apart] for k in r[:2]}


def pick(first: str, then: str) -> str:
    """Ends of a rule's conclusion after another rule's."""
    return "".join(first[0] if x == "s" else first[1] for x in then)


def text(e) -> str:
    """A class expression as text."""
    if isinstance(e, str):
        return e
    kind, *rest = e
    if kind == "inverse":
        return f"inverse({rest[0]})"
    if kind in ("and", "or"):
        return "(" + (" and " if kind == "and" else " or ").join(map(text, rest)) + ")"
    if kind == "not":
        return f"(complementOf {text(rest[0])})"
    if kind == "one":
        return "{" + ", ".join(rest) + "}"
    if kind in ("some", "only", "value"):
        word = {"some": "someValuesFrom", "only": "allValuesFrom", "value": "hasValue"}[kind]
        return f"({text(rest[0])} {word} {text(rest[1])})"
    if kind == "self":
        return f"({text(rest[0])} hasSelf)"
    return f"({text(rest[1])} {kind} {rest[0]} {text(rest[2])})"


class _Compiler:
    def __init__(self):
        self.rules, self.seen, self.inverses = Rules(), {}, set()

    def fresh(self, e) -> str:
        return f"{TYPE}nested {text(e)}"

    def prop(self, p) -> str:
        if isinstance(p, str):
            return p
        name, base = text(p), p[1]
        if name not in self.inverses:
            self.inverses.add(name)
            self.rules.one += [(base, name, "os", ()), (name, base, "os", ())]
        return name

    def out(self, axiom: str, reason: str) -> None:
        self.rules.left_out.append((axiom, reason))

    def below(self, e, why: str) -> str | None:
        """A key whose members are all that rules can tell to be in e; None for everything."""
        if isinstance(e, str):
            return None if e in _THINGS else TYPE + e
        kind, *rest = e
        name = self.fresh(e)
        if name in self.seen:
            return self.seen[name]
        self.seen[name] = name
        r = self.rules
        if kind == "and":
            parts = [k for x in rest if (k := self.below(x, why)) is not None]
            if not parts:
                self.seen[name] = None
                return None
            while len(parts) > 2:
                joint = f"{TYPE}nested " + " & ".join(parts[:2])
                r.two.append((parts[0], parts[1], joint, "aa", ()))
                parts = [joint, *parts[2:]]
            if len(parts) == 2:
                r.two.append((*parts, name, "aa", ()))
            else:
                r.one.append((parts[0], name, "so", ()))
        elif kind == "or":
            for x in rest:
                if (k := self.below(x, why)) is None:
                    self.seen[name] = None
                    return None
                r.one.append((k, name, "so", ()))
        elif kind == "some" or (kind == "min" and rest[0] == 1):
            p, filler = (rest[0], rest[1]) if kind == "some" else (rest[1], rest[2])
            p, k = self.prop(p), self.below(filler, why)
            r.one.append((p, name, "ss", ())) if k is None else r.two.append((p, k, name, "aa", ()))
        elif kind == "min" and rest[0] == 0:
            self.seen[name] = None
            return None
        elif kind == "value":
            r.value.append((self.prop(rest[0]), rest[1], name, ()))
        elif kind == "self":
            r.loops.append((self.prop(rest[0]), name, ()))
        elif kind == "one":
            r.nominal += [(v, name, ()) for v in rest]
        else:
            self.out(why, f"{text(e)} as a condition needs more than rules")
        return name

    def above(self, k: str | None, e, why: str) -> None:
        """Members of key k are in e."""
        r, because = self.rules, (why,)
        if isinstance(e, str) and e in _THINGS:
            return
        if k is None:
            k = TYPE + THING
            r.left_out.append((why, "a statement on everything"))
            return
        if isinstance(e, str):
            if e in _NOTHINGS:
                r.never.append((k, k, because))
            else:
                r.one.append((k, TYPE + e, "so", because))
            return
        kind, *rest = e
        if kind == "and":
            for x in rest:
                self.above(k, x, why)
        elif kind == "or" and len(rest) == 1:
            self.above(k, rest[0], why)
        elif kind == "some" or (kind == "min" and rest[0] >= 1):
            p, filler = (rest[0], rest[1]) if kind == "some" else (rest[1], rest[2])
            if kind == "min" and rest[0] > 1:
                self.out(why, f"{text(e)}: one of the successors is used")
            p = self.prop(p)
            if isinstance(filler, tuple) and filler[0] == "one" and len(filler) == 2:
                r.gives.append((k, p, filler[1], because))
                return
            r.exists.append((k, p, self.inside(filler, why), because))
        elif kind == "min":
            return
        elif kind == "only":
            r.two.append((k, self.prop(rest[0]), self.inside(rest[1], why), "bb", because))
        elif kind == "value":
            r.gives.append((k, self.prop(rest[0]), rest[1], because))
        elif kind == "self":
            r.one.append((k, self.prop(rest[0]), "ss", because))
        elif kind == "max" and rest[0] <= 1:
            p, filler = self.prop(rest[1]), self.below(rest[2], why)
            if rest[0] == 1:
                r.unique.append((k, p, filler or "", because))
            else:
                r.never.append((k, self.below(("some", rest[1], rest[2]), why), because))
        elif kind == "exact" and rest[0] <= 1:
            self.above(k, ("max", *rest), why)
            self.above(k, ("min", *rest), why)
        elif kind == "not":
            other = self.below(rest[0], why)
            r.never.append((k, other or k, because))
        elif kind == "one" and len(rest) == 1:
            r.single.append((k, rest[0], because))
        else:
            self.out(why, f"{text(e)} as a conclusion needs case distinctions")

    def inside(self, e, why: str) -> str:
        """A key for the members of e on the conclusion's side, with what follows from them."""
        if isinstance(e, str) and e not in _NOTHINGS:
            return TYPE + e
        name = f"{TYPE}nested in {text(e)}"
        if name not in self.seen:
            self.seen[name] = name
            self.above(name, e, why)
        return name


def compiled(t: Terminology, strict: bool = True, backwards: bool = False) -> Rules:
    """The rules of a terminology. What no rule covers is in `left_out`; strict: raise NotUnderstood if there is any. Chains are
    read from the front, or backwards from their last property: the same facts, by other pairs on the way.

    Left out on purpose, as they ask for case distinctions: alternatives as conclusions, complements and upper bounds as
    conditions, bounds over one. The part of such an axiom that rules do cover still counts. Of a definition (an equivalence)
    the conclusions that would need them are in `halves` and raise nothing.
    """
    c = _Compiler()
    r = c.rules
    for p, q in t.sub_property:
        r.one.append((p, q, "so", (f"{p} rdfs:subPropertyOf {q}",)))
    for p, q in t.equivalent_property:
        why = (f"{p} owl:equivalentProperty {q}",)
        r.one += [(p, q, "so", why), (q, p, "so", why)]
    for p, q in t.inverse:
        why = (f"{p} owl:inverseOf {q}",)
        r.one += [(p, q, "os", why), (q, p, "os", why)]
    r.one += [(p, p, "os", (f"SymmetricObjectProperty({p})",)) for p in t.symmetric]
    r.two += [(p, p, p, "ab", (f"TransitiveObjectProperty({p})",)) for p in t.transitive]
    for *steps, q in t.chains:
        why = f"{' ∘ '.join(steps)} → {q}"
        if len(steps) == 1:
            r.one.append((steps[0], q, "so", (why,)))
        else:
            r.two += [(a, b, x, "ab", (why,) if x == q else ()) for a, b, x in (chain_steps_back if backwards else chain_steps)([(*steps, q)])]
    r.one += [(p, TYPE + x, "ss", (f"domain({p}) = {x}",)) for p, x in t.domain]
    r.one += [(p, TYPE + x, "oo", (f"range({p}) = {x}",)) for p, x in t.range]
    for x, y in t.sub_class:
        c.above(TYPE + x, y, f"{x} SubClassOf {y}")
    for x, y in t.equivalent_class:
        why = f"{x} owl:equivalentClass {y}"
        c.above(TYPE + x, y, why)
        c.above(TYPE + y, x, why)
    for x, parts in t.unions:
        for y in parts:
            c.above(c.below(y, x), x, f"{x} unionOf {text(y)}")
    for x, parts in t.intersections:
        parts = [y if isinstance(y, str) else ("some", *y) if len(y) == 2 else y for y in parts]
        why = f"{x} intersectionOf {', '.join(map(text, parts))}"
        c.above(c.below(("and", *parts), why), x, why)
        for y in parts:
            c.above(TYPE + x, y, why)
    for p, d, x in t.some:
        c.above(c.below(("some", p, d), x), x, f"{p} someValuesFrom {d}")
    for x, p, d in t.only:
        c.above(TYPE + x, ("only", p, d), f"{p} allValuesFrom {d}")
    for x, p, d in t.exists:
        c.above(TYPE + x, ("some", p, d), f"{x} SubClassOf ({p} someValuesFrom {d})")
    for x, y in t.disjoint:
        r.never.append((TYPE + x, TYPE + y, (f"{x} owl:disjointWith {y}",)))
    r.apart += [(p, q, (f"{p} owl:propertyDisjointWith {q}",)) for p, q in t.disjoint_property]
    r.unique += [("", p, "", (f"FunctionalObjectProperty({p})",)) for p in t.functional]
    r.back += [(p, (f"InverseFunctionalObjectProperty({p})",)) for p in t.inverse_functional]
    both = set(t.expressions)
    for x, y in t.expressions:
        why, n = f"{text(x)} SubClassOf {text(y)}", len(r.left_out)
        c.above(c.below(x, why), y, why)
        if (y, x) in both:  # a definition: what follows from its name may be beyond rules, what makes a member isn't
            r.halves += [z for z in r.left_out[n:] if z[1].endswith("case distinctions")]
            r.left_out[n:] = [z for z in r.left_out[n:] if not z[1].endswith("case distinctions")]
    for x, q in t.self_rules():
        r.one.append((TYPE + x, q, "ss", (f"{x} has a successor and {q} leads there and back",)))
    functional = {p for p in t.functional}
    r.two += [(k, p, b, "bb", (*why, f"FunctionalObjectProperty({p})")) for k, p, b, why in r.exists if p in functional]
    for part in (r.one, r.two, r.value, r.gives, r.loops, r.nominal, r.unique, r.back, r.single, r.never, r.apart, r.exists):
        part[:] = dict.fromkeys(part)
    if strict and r.left_out:
        raise NotUnderstood(r.left_out)
    return r


def composed(one: list) -> list[tuple[str, str, str]]:
    """(k0, k1, ends): what rules of one premise make of a fact, one after the other; without the fact itself."""
    step = defaultdict(set)
    for k0, k1, ends, *_ in one:
        step[k0].add((k1, ends))
    out = []
    for k0 in sorted(step):
        own = ((k0, "ss"),) if k0.startswith(TYPE) else ((k0, "so"),)
        seen, todo = set(own), list(own)
        while todo:
            k, ends = todo.pop()
            for k1, then in step.get(k, ()):
                n = (k1, pick(ends, then))
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out += [(k0, k, ends) for k, ends in sorted(seen - set(own))]
    return out
