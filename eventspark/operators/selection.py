"""Trees of event selections: each node adds cuts and weights to its parent."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import coll, kin, ops

Z_MASS = 91.1876
Z_WINDOW = 10.0
LOW_MASS = 12.0


@dataclass(frozen=True)
class Selection:
    """Node of a selection tree; ``sel_<name>`` is its flag column."""

    name: str
    parent: "Selection | None" = None
    cut: Column | None = None
    weight: Column | None = None

    def refine(self, name: str, cut: Column | Iterable[Column] | None = None, weight: Column | None = None):
        if cut is not None and not isinstance(cut, Column):
            cut = ops.all_of(*cut)
        return Selection(name, self, cut, weight)

    @property
    def flag(self) -> str:
        return f"sel_{self.name}"

    def lineage(self) -> list["Selection"]:
        """Root first, this node last."""
        return [*(self.parent.lineage() if self.parent else []), self]

    def total_weight(self) -> Column:
        """Product of the weights along the lineage."""
        out = None
        for node in self.lineage():
            if node.weight is not None:
                out = node.weight if out is None else out * node.weight
        return F.lit(1.0) if out is None else out


def with_flags(df: DataFrame, selections: Iterable[Selection]) -> DataFrame:
    """Add one boolean column per node of every lineage; children reuse the parent's column."""
    done: set[str] = set()
    levels: dict[int, list[Selection]] = {}
    for sel in selections:
        for depth, node in enumerate(sel.lineage()):
            if node.name not in done:
                done.add(node.name)
                levels.setdefault(depth, []).append(node)
    for depth in sorted(levels):
        flags = {}
        for node in levels[depth]:
            own = F.lit(True) if node.cut is None else ops.passed(node.cut)
            flags[node.flag] = own if node.parent is None else F.col(node.parent.flag) & own
        df = df.withColumns(flags)
    return df


def expanded(selections: Iterable[Selection]) -> list[Selection]:
    """The selections and all their ancestors, each once, ancestors first."""
    seen: dict[str, Selection] = {}
    for sel in selections:
        for node in sel.lineage():
            seen.setdefault(node.name, node)
    return list(seen.values())


# --- cuts shared by both channels -------------------------------------------------------------------------------


def _opposite(a: Column, b: Column) -> Column:
    return a["charge"] != b["charge"]


def lepton_pairs(df: DataFrame, electrons: str, muons: str) -> DataFrame:
    """Number and first of the opposite-charge pairs: ``n_ee, n_mm, n_em`` and ``first_ee, first_mm, first_em``.

    Pairs are counted from the charges (each positive or negative) and never listed, so an event with many leptons needs
    no more memory than its leptons.
    """
    e, m = F.col(electrons), F.col(muons)
    plus = lambda arr: coll.n(coll.select(arr, lambda x: x["charge"] > 0))
    minus = lambda arr: coll.n(coll.select(arr, lambda x: x["charge"] < 0))
    return df.withColumns(
        {
            "n_ee": plus(e) * minus(e),
            "n_mm": plus(m) * minus(m),
            "n_em": plus(e) * minus(m) + minus(e) * plus(m),
            "first_ee": coll.first_pair(e, _opposite),
            "first_mm": coll.first_pair(m, _opposite),
            "first_em": coll.first_cross(e, m, _opposite),
        }
    )


def _paired(cut):
    """An opposite-charge pair whose mass satisfies ``cut``."""
    return lambda a, b: _opposite(a, b) & cut(kin.inv_mass(a, b))


def low_mass_pair(limit: float = LOW_MASS) -> coll.PairPredicate:
    return _paired(lambda x: x < limit)


def z_pair(mass: float = Z_MASS, window: float = Z_WINDOW) -> coll.PairPredicate:
    return _paired(lambda x: F.abs(x - mass) <= window)


def no_low_mass(e: Column, m: Column, limit: float = LOW_MASS) -> Column:
    """No opposite-charge pair of any flavour below ``limit``."""
    low = low_mass_pair(limit)
    return ~(coll.any_pair(e, low) | coll.any_pair(m, low) | coll.any_cross(e, m, low))


def no_z(e: Column, m: Column, mass: float = Z_MASS, window: float = Z_WINDOW) -> Column:
    """No opposite-charge pair of one flavour within ``window`` of ``mass``."""
    near = z_pair(mass, window)
    return ~(coll.any_pair(e, near) | coll.any_pair(m, near))


def vetoes() -> tuple[Column, Column]:
    """Both vetoes, on the loose leptons."""
    e, m = F.col("clean_electrons"), F.col("muons")
    return no_low_mass(e, m), no_z(e, m)


def with_vetoes(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Both vetoes as columns; with ``where`` they are looked for in those events only and NULL in the others."""
    found = dict(zip(("ok_low", "ok_z"), vetoes(), strict=True))
    return df.withColumns(found if where is None else {c: F.when(where, v) for c, v in found.items()})


#: Cone-pt of both leptons of a pair, of the harder one, and of the only electron and muon.
PAIR_EACH, PAIR_LEADING, ONE_ELECTRON, ONE_MUON = 15.0, 25.0, 32.0, 25.0


def pair_conept_cut(pair: Column, each: float = PAIR_EACH, leading: float = PAIR_LEADING) -> Column:
    a, b = pair["l1"]["conept"], pair["l2"]["conept"]
    above = ops.above
    return above(a, each) & above(b, each) & (above(a, leading) | above(b, leading))


# --- two-lepton channel -----------------------------------------------------------------------------------------

# flavour -> names of the pt and Z-veto nodes
DL_FLAVOURS = {
    "ee": ("elelptSel", "OSoutZelelSel"),
    "mumu": ("mumuptSel", "OSoutZmumuSel"),
    "emu": ("elmuptSel", "OSoutZelmuSel"),
}
DL_PAIRS = {"ee": "ee", "mumu": "mm", "emu": "em"}


def mixed_by_pt(df: DataFrame) -> DataFrame:
    """Leptons of the first mixed pair by pt."""
    mixed = F.col("first_em")
    lead, sub = ops.lead_sub(kin.four_vector(mixed["l1"]), kin.four_vector(mixed["l2"]))
    return df.withColumns({"em_lead": lead, "em_sub": sub})


def dl_columns(df: DataFrame) -> DataFrame:
    """Pairs the two-lepton selections read."""
    return mixed_by_pt(with_vetoes(lepton_pairs(df, "tight_electrons", "tight_muons")))


def _one_pair(own: str) -> list[Column]:
    return [F.col(f"n_{p}") == (1 if p == own else 0) for p in DL_PAIRS.values()]


def dl_tight() -> Column:
    """Whether the tight leptons, with :func:`lepton_pairs`, are those of a last two-lepton selection."""
    return ops.any_of(*[ops.passed(ops.all_of(*_one_pair(p), pair_conept_cut(F.col(f"first_{p}")))) for p in DL_PAIRS.values()])


def dl_selections(base: Selection) -> list[Selection]:
    """Boosted and resolved selections for ee, mumu and emu."""
    low, z = F.col("ok_low"), F.col("ok_z")
    boosted, resolved = [], []
    for flavour, (pt_name, os_name) in DL_FLAVOURS.items():
        own = DL_PAIRS[flavour]
        hard = base.refine(pt_name, cut=pair_conept_cut(F.col(f"first_{own}")))
        off_z = hard.refine(os_name, cut=[low, z])
        one_pair = off_z.refine(
            f"dileptonCut_{flavour}",
            cut=_one_pair(own),
        )
        boosted.append(one_pair.refine(f"DL_boosted_{flavour}", cut=F.size("ak8_bjets") >= 1))
        resolved.append(
            one_pair.refine(
                f"DL_resolved_{flavour}",
                cut=[F.size("ak4_jets") >= 2, F.size("ak4_bjets") >= 1, F.size("ak8_jets") == 0],
            )
        )
    return boosted + resolved


# --- one-lepton channel -----------------------------------------------------------------------------------------


def sl_columns(df: DataFrame) -> DataFrame:
    return with_vetoes(df)


def _one_lepton(electron_conept: float = ONE_ELECTRON, muon_conept: float = ONE_MUON) -> tuple[list[Column], list[Column]]:
    one_electron = [
        coll.at(F.col("tight_electrons"), 0)["conept"] > electron_conept,
        F.size("tight_electrons") == 1,
        F.size("tight_muons") == 0,
    ]
    one_muon = [
        coll.at(F.col("tight_muons"), 0)["conept"] > muon_conept,
        F.size("tight_electrons") == 0,
        F.size("tight_muons") == 1,
    ]
    return one_electron, one_muon


def sl_tight() -> Column:
    """Whether the tight leptons are those of a last one-lepton selection."""
    return ops.any_of(*[ops.passed(ops.all_of(*cuts)) for cuts in _one_lepton()])


def sl_selections(base: Selection, electron_conept: float = ONE_ELECTRON, muon_conept: float = ONE_MUON) -> list[Selection]:
    """Resolved and boosted selections, inclusive and for one electron or one muon."""
    low, z = F.col("ok_low"), F.col("ok_z")
    start = base.refine("OSoutZsel", cut=[low, z, F.size("taus") == 0])
    one_electron, one_muon = _one_lepton(electron_conept, muon_conept)
    regions = {
        "SL_resolved": [F.size("ak4_jets") >= 3, F.size("ak4_bjets") >= 1, F.size("ak8_bjets") == 0],
        "SL_boosted": [F.size("ak8_bjets") >= 1, F.size("ak4_away") >= 1],
    }
    out = []
    for name, cuts in regions.items():
        region = start.refine(name, cut=cuts)
        out += [region, region.refine(f"{name}_e", cut=one_electron), region.refine(f"{name}_mu", cut=one_muon)]
    return out
