"""The corpus of small theorems: families of variants, as seeds and proposals tables.

A family gives a name, hypotheses and a goal as patterns over its variants' letters; a theorem's statement is
its hypotheses in brackets and its goal, its first state the hypotheses and the goal on lines of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sievetrace import schema


@dataclass(frozen=True)
class Family:
    """Variants of one pattern; ``special`` are (name, hypotheses, goal, statement or None, correct or None, wrong or None)."""

    name: str
    pattern: str
    variants: tuple[str, ...]
    hypotheses: tuple[str, ...]
    goal: str
    correct: tuple[str, ...]
    wrong: tuple[str, ...]
    special: tuple[tuple, ...] = field(default=())


# Patterns, variants and actions of the published corpus.
PAIRS = ("pq", "ab", "rs", "xy", "pr", "qt", "su")
PROPS = "{0} {1} : Prop"
TYPES = {"Nat": "nat", "Bool": "bool", "String": "string"}
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma"}


def _typed(prefix: str, letters: str, more: tuple[str, ...], goal: str, greek: int) -> tuple[tuple, ...]:
    """Variants over concrete types and over type variables."""
    plain = [(f"{prefix}_{n}", (f"{letters} : {t}", *more), goal) for t, n in TYPES.items()]
    open_ = [(f"{prefix}_{n}", (f"{t} : Type", f"{letters} : {t}", *more), goal) for t, n in list(GREEK.items())[:greek]]
    return tuple((*v, None, None, None) for v in (*plain, *open_))


def _arith(*rows: tuple[str, str, str]) -> tuple[tuple, ...]:
    return tuple((f"nat_{n}", (), goal, f": {said}", None, None) for n, said, goal in rows)


FAMILIES = (
    Family("imp_identity", "imp_id_{0}", tuple("pqrsta"), ("{0} : Prop",), "{0} → {0}", ("intro h\n  exact h", "exact fun h => h", "exact id"), ("rfl",),
           (("imp_id_and", ("p q : Prop",), "p ∧ q → p ∧ q", "(p q : Prop) : (p ∧ q) → (p ∧ q)", None, None), ("imp_id_or", ("p q : Prop",), "p ∨ q → p ∨ q", "(p q : Prop) : (p ∨ q) → (p ∨ q)", None, None))),
    Family("imp_compose", "imp_compose_{0}{1}{2}", ("pqr", "abc", "xyz", "prs", "qrt", "acd"), ("{0} {1} {2} : Prop", "h1 : {0} → {1}", "h2 : {1} → {2}"), "{0} → {2}",
           ("intro hp\n  exact h2 (h1 hp)", "exact fun hp => h2 (h1 hp)"), ("exact h2", "exact h1", "rfl")),
    Family("modus_ponens", "mp_{0}{1}", PAIRS[:6], (PROPS, "hp : {0}", "hpq : {0} → {1}"), "{1}", ("exact hpq hp", "apply hpq\n  exact hp"), ("exact hp", "exact hpq", "rfl")),
    Family("and_intro", "and_intro_{0}{1}", ("pq", "ab", "rs", "xy", "pr", "qs"), (PROPS, "hp : {0}", "hq : {1}"), "{0} ∧ {1}", ("exact ⟨hp, hq⟩", "exact And.intro hp hq", "constructor\n  exact hp\n  exact hq"), ("exact ⟨hq, hp⟩", "rfl"),
           (("and_intro_nested", ("p q r : Prop", "hp : p", "hq : q ∧ r"), "p ∧ (q ∧ r)", None, ("exact ⟨hp, hq⟩", "exact And.intro hp hq"), None),)),
    Family("and_elim_left", "and_left_{0}{1}", PAIRS, (PROPS, "h : {0} ∧ {1}"), "{0}", ("exact h.1", "exact h.left", "exact And.left h"), ("exact h.2", "rfl")),
    Family("and_elim_right", "and_right_{0}{1}", PAIRS, (PROPS, "h : {0} ∧ {1}"), "{1}", ("exact h.2", "exact h.right", "exact And.right h"), ("exact h.1", "rfl")),
    Family("and_comm", "and_comm_{0}{1}", PAIRS[:6], (PROPS, "h : {0} ∧ {1}"), "{1} ∧ {0}", ("exact ⟨h.2, h.1⟩", "rcases h with ⟨hp, hq⟩\n  exact ⟨hq, hp⟩", "cases h with\n  | intro hp hq => exact ⟨hq, hp⟩"), ("exact h", "rfl")),
    Family("or_intro_left", "or_inl_{0}{1}", PAIRS, (PROPS, "h : {0}"), "{0} ∨ {1}", ("exact Or.inl h", "left\n  exact h"), ("exact Or.inr h", "exact h", "rfl")),
    Family("or_intro_right", "or_inr_{0}{1}", PAIRS, (PROPS, "h : {1}"), "{0} ∨ {1}", ("exact Or.inr h", "right\n  exact h"), ("exact Or.inl h", "exact h", "rfl")),
    Family("or_comm", "or_comm_{0}{1}", PAIRS[:5], (PROPS, "h : {0} ∨ {1}"), "{1} ∨ {0}", ("rcases h with hp | hq\n  exact Or.inr hp\n  exact Or.inl hq", "cases h with\n  | inl hp => exact Or.inr hp\n  | inr hq => exact Or.inl hq"), ("exact h", "rfl")),
    Family("or_self_elim", "or_self_{0}", tuple("pqrst"), ("{0} : Prop", "h : {0} ∨ {0}"), "{0}", ("rcases h with hp | hp\n  exact hp\n  exact hp", "cases h with\n  | inl hp => exact hp\n  | inr hp => exact hp"), ("exact h", "rfl")),
    Family("iff_intro", "iff_intro_{0}{1}", PAIRS[:6], (PROPS, "h1 : {0} → {1}", "h2 : {1} → {0}"), "{0} ↔ {1}", ("exact ⟨h1, h2⟩", "exact Iff.intro h1 h2", "constructor\n  exact h1\n  exact h2"), ("exact ⟨h2, h1⟩", "rfl")),
    Family("iff_mp", "iff_mp_{0}{1}", PAIRS[:6], (PROPS, "h : {0} ↔ {1}", "hp : {0}"), "{1}", ("exact h.mp hp", "exact h.1 hp"), ("exact h.mpr hp", "exact hp", "rfl")),
    Family("iff_mpr", "iff_mpr_{0}{1}", PAIRS[:6], (PROPS, "h : {0} ↔ {1}", "hq : {1}"), "{0}", ("exact h.mpr hq", "exact h.2 hq"), ("exact h.mp hq", "exact hq", "rfl")),
    Family("eq_refl", "", (), (), "", ("rfl", "exact rfl", "exact Eq.refl a"), ("exact a",),
           (*_typed("eq_refl", "a", (), "a = a", 2), ("eq_refl_pair", ("α : Type", "a b : α"), "a = a", None, None, None))),
    Family("eq_symm", "", (), (), "", ("exact h.symm", "exact Eq.symm h"), ("exact h", "rfl"), _typed("eq_symm", "a b", ("h : a = b",), "b = a", 3)),
    Family("eq_trans", "", (), (), "", ("exact h1.trans h2", "exact Eq.trans h1 h2"), ("exact h1", "exact h2", "rfl"), _typed("eq_trans", "a b c", ("h1 : a = b", "h2 : b = c"), "a = c", 3)),
    Family("nat_rfl", "", (), (), "", ("rfl", "exact rfl", "decide"), ("exact 0",), _arith(
        ("lit2", "(2 : Nat) = 2", "2 = 2"), ("lit5", "(5 : Nat) = 5", "5 = 5"), ("lit10", "(10 : Nat) = 10", "10 = 10"), ("add11", "(1 + 1 : Nat) = 2", "1 + 1 = 2"), ("add23", "(2 + 3 : Nat) = 5", "2 + 3 = 5"),
        ("add40", "(4 + 0 : Nat) = 4", "4 + 0 = 4"), ("mul23", "(2 * 3 : Nat) = 6", "2 * 3 = 6"), ("succ", "(Nat.succ 2) = 3", "Nat.succ 2 = 3"), ("add_chain", "(1 + 2 + 3 : Nat) = 6", "1 + 2 + 3 = 6"))),
    Family("exists_witness", "exists_nat_{0}", tuple("01257"), (), "∃ n : Nat, n = {0}", ("exact ⟨{0}, rfl⟩", "refine ⟨{0}, ?_⟩\n  rfl"), ("exact rfl", "rfl"),
           (*((f"exists_self_{GREEK[t]}", (f"{t} : Type", f"a : {t}"), f"∃ x : {t}, x = a", None, ("exact ⟨a, rfl⟩", "refine ⟨a, ?_⟩\n  rfl"), ("exact a", "rfl")) for t in "αβ"),
            ("exists_nat_refl", (), "∃ n : Nat, n = n", None, ("exact ⟨0, rfl⟩", "exact ⟨1, rfl⟩"), ("rfl",)))),
    Family("false_elim", "false_elim_{0}", tuple("pqrst"), ("{0} : Prop", "h : False"), "{0}", ("exact h.elim", "exact False.elim h", "contradiction"), ("exact h", "rfl")),
    Family("true_intro", "true_const_{0}", tuple("pqrs"), ("{0} : Prop", "h : {0}"), "True", ("trivial", "exact True.intro"), ("exact h", "rfl"),
           (("true_bare", (), "True", None, ("trivial", "exact True.intro", "constructor"), ("rfl",)),)),
)


def _row(name: str, family: str, hypotheses: tuple[str, ...], goal: str, said: str | None, correct: tuple[str, ...], wrong: tuple[str, ...]) -> dict:
    statement = said or " ".join([*(f"({h})" for h in hypotheses), f": {goal}"])
    return {"name": name, "family": family, "statement": statement, "state": "\n".join([*hypotheses, f"⊢ {goal}"]), "correct": list(correct), "candidates": list(dict.fromkeys([*correct, *wrong]))}


def entries() -> list[dict]:
    """All theorems; ValueError for a name that comes twice."""
    out = []
    for f in FAMILIES:
        for v in f.variants:
            fill = lambda xs: tuple(x.format(*v) for x in xs)
            correct = fill(f.correct) if f.name == "exists_witness" else f.correct
            out.append(_row(f.pattern.format(*v), f.name, fill(f.hypotheses), f.goal.format(*v), None, correct, f.wrong))
        out += [_row(name, f.name, hyps, goal, said, correct or f.correct, wrong or f.wrong) for name, hyps, goal, said, correct, wrong in f.special]
    names = [e["name"] for e in out]
    if len(set(names)) < len(names):
        raise ValueError("a theorem's name comes twice")
    return out


def seeds(spark: SparkSession) -> DataFrame:
    """The corpus as a seeds table."""
    rows = [
        (e["name"], e["statement"], None, None, None, e["state"], None, None, None, [], f"example {e['statement']} := by\n  {schema.ACTION_SLOT}", schema.ACTION_SLOT, (e["family"], e["correct"]), 0, k)
        for k, e in enumerate(entries())
    ]
    return spark.createDataFrame(rows, f"{schema.SEEDS}, _file_ord int, _line_no bigint")


def proposals(spark: SparkSession) -> DataFrame:
    """The corpus as a proposals table: correct actions, then wrong ones, each once."""
    rows = [(e["name"], e["state"], e["candidates"], "manual-corpus", "diverse", None, 0, k) for k, e in enumerate(entries())]
    return spark.createDataFrame(rows, f"{schema.CANDIDATES}, _file_ord int, _line_no bigint")
