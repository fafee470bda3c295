"""The whole chain: weighted, triggered events -> objects -> selections -> histograms, cut-flow and skim."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from eventspark.functions import coll, ops
from eventspark.operators import events, hist, objects, report, selection, weights
from eventspark.operators.checkpoints import pinned
from eventspark.operators.mlprep import SCORE_EDGES, category_cuts
from eventspark.operators.objects import DEFAULT, Cuts
from eventspark.operators.selection import Selection
from eventspark.plans import plots
from eventspark.sources import catalog, skim

#: Column by which ``vary`` may tell the events whose collections are needed, if a channel is made with ``last``.
PASSED = "_passed"


@dataclass(frozen=True)
class Channel:
    """Events of one channel with objects and selection flags, and what can be made from them."""

    name: str
    events: DataFrame
    selections: list[Selection]
    make_plots: Callable[[], list[hist.Plot]]
    #: Whether the events have the flags of inner nodes.
    inner: bool = True

    def weighted(self, column: str, weight: Column) -> Channel:
        """The channel with a weight that may use its objects, as a column."""
        return replace(self, events=self.events.withColumn(column, weight))

    @property
    def plots(self) -> list[hist.Plot]:
        return self.make_plots()

    def histograms(self, weight: Column, by: tuple[str, ...] = ("sample",)) -> DataFrame:
        return hist.fill_many(self.events, self.plots, weight, by)

    def cutflow(self, weight: Column, by: tuple[str, ...] = ("sample",)) -> DataFrame:
        if not self.inner:
            raise ValueError("a cut-flow needs the inner nodes; make the channel without `last`")
        return report.cutflow(self.events, self.selections, weight, by)

    def skim(self, weight: Column, keep: tuple[str, ...] = ("sample",)) -> DataFrame:
        """Classifier inputs of the resolved electron selection with the base weight."""
        flag, features = (
            ("sel_DL_resolved_ee", skim.dl_features()) if self.name == "DL" else ("sel_SL_resolved_e", skim.sl_features())
        )
        return skim.rows(self.events, F.col(flag), {"weight": weight, **features}, keep)


def prepared(
    df: DataFrame,
    ranges: DataFrame,
    bits: Mapping[str, Sequence[Column]],
    jec: DataFrame,
    bins: Mapping[str, Sequence[weights.FactorBin]],
    weight: str = "weight",
) -> DataFrame:
    """Certified and triggered events with their generator weight, corrected jets and the momentum balance that follows.

    ``bins`` has the residual corrections of every collection of jets to correct; the balance follows ``Jet``.
    """
    data = F.col("type") == "data"
    df = events.trigger(events.certified(df, ranges, only=data), data, F.col("sample"), bits)
    df = df.withColumn(weight, weights.gen(~data, F.col(weight)))
    df = weights.with_jec(df.withColumn("run_era", catalog.run_era(F.col("sample"))), jec)
    # columns of their own, so that both components of the balance read the corrected jets instead of making them again
    df = df.withColumns({f"_new_{c}": weights.corrected(F.col(c), b) for c, b in bins.items()})
    pt, phi = weights.met_shift(F.col("met_pt"), F.col("met_phi"), F.col("Jet"), F.col("_new_Jet"))
    df = df.withColumns({"met_pt": pt, "met_phi": phi})
    df = df.withColumns({c: F.col(f"_new_{c}") for c in bins})
    return df.drop("run_era", "jec_tag", "jec_factor", *[f"_new_{c}" for c in bins])


def simulation_weight(
    btag_bins: Sequence[weights.FactorBin], flavour: Callable[[Column], Column], weight: str = "weight"
) -> Column:
    """Event weight with the b-tag factors of the cleaned jets and the top-pt weight; data keep theirs."""
    factor = lambda x: weights.binned_factor(btag_bins, flavour(x), x["pt"], x["btagDeepFlavB"])
    btag = weights.lookup_product(F.col("ak4_jets"), factor)
    full = F.col(weight) * btag * weights.top_pt(F.col("GenPart"), F.col("sample"))
    return F.when(F.col("type") == "data", F.col(weight)).otherwise(full)


def categories(parent: Selection, score: Column) -> list[Selection]:
    """One selection per score interval."""
    return [parent.refine(f"DNNcat{i}", cut=inside) for i, inside in category_cuts(score, SCORE_EDGES).items()]


def channel(
    df: DataFrame,
    name: str,
    score: Column | None = None,
    cuts: Cuts = DEFAULT,
    vary: Callable[[DataFrame], DataFrame] | None = None,
    more: DataFrame | None = None,
    last: bool = False,
    stored: Callable[[DataFrame], DataFrame] | None = None,
) -> Channel:
    """Objects and selections of channel ``DL`` or ``SL`` for already triggered and weighted events.

    ``vary`` may repeat the events with changed jets (see :func:`syst.object_variations`); the leptons, which do not
    depend on jet momenta, are built before it, once per event.

    ``more`` has events with everything that selections and plots read already in it (see
    :func:`crowded_objects.summary`); they are added before the selections, and only columns of both stay.

    With ``score`` (an expression over the derived collections) the two-lepton channel also gets the score categories
    and their plots.

    With ``last`` only the selections by lepton flavour, which plots and skims are of, are made (see :func:`_last`), and the
    collections of an event whose leptons fail all of them are NULL. Then ``stored`` may add the collections that leptons are
    not defined by (all but ``Muon``, ``Electron`` and ``Jet``), so that other events' are never built.
    """
    base = Selection("noSel")
    if last:
        found = _last(df, name, cuts, vary, stored)
    else:
        found = objects.define_leptons(df, name, cuts)
        found = selection.dl_columns(found) if name == "DL" else selection.sl_columns(found)
        if vary is not None:
            found = vary(found)
    found = objects.fat_jets(objects.jets(found, cuts.jets), name, cuts.jets)
    if more is not None:
        both = [c for c in found.columns if c in more.columns]
        found = found.select(both).unionByName(more.select(both))
    if name == "DL":
        chosen, drawn = selection.dl_selections(base), plots.dl_plots
        if score is not None:
            found = found.withColumn("score", score)
            chosen = chosen + categories(next(s for s in chosen if s.name == "DL_resolved_ee"), F.col("score"))
            drawn = lambda: plots.score_plots(F.col("score")) + plots.dl_plots()
    else:
        chosen, drawn = selection.sl_selections(base), plots.sl_plots
    flagged = selection.with_flags(found, chosen)
    if last:
        # the flags of inner nodes do not hold for events left out early
        chosen = [s for s in chosen if s.name not in ("SL_resolved", "SL_boosted")]
        inner = {s.flag for s in selection.expanded(chosen)} - {s.flag for s in chosen} - {base.flag}
        flagged = flagged.drop(*inner)
    return Channel(name, flagged, chosen, drawn, inner=not last)


def _last(
    df: DataFrame,
    name: str,
    cuts: Cuts,
    vary: Callable[[DataFrame], DataFrame] | None,
    stored: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Leptons, and what else the selections read of those events only whose leptons pass a last selection.

    Cheap conditions come first: tight leptons, then vetoes and taus, then jets.
    """
    found = df if "tight_electrons" in df.columns else objects.electrons(objects.muons(df, cuts.leptons), cuts.leptons)
    found = _with_tight(found, name)
    if stored is not None:
        late = set(df.columns) - {"Muon", "Electron", "Jet"}
        found = stored(coll.only_where(found, F.col("_tight"), *[c for c in _nested(found) if c in late]))
    found = objects.taus(coll.only_where(found, F.col("_tight"), "Tau"), cuts.taus)
    found = selection.with_vetoes(objects.lead_leptons(found, name), F.col("_tight"))
    passed = [F.col("_tight"), F.col("ok_low"), F.col("ok_z")]
    if name == "SL":
        passed.append(F.size("taus") == 0)
    found = found.withColumn(PASSED, ops.passed(ops.all_of(*passed))).drop("_tight")
    found = coll.only_where(found, F.col(PASSED), *[c for c in _nested(found) if c != "Jet"])
    found = found if vary is None else vary(found)
    return coll.only_where(found, F.col(PASSED), "Jet").drop(PASSED)


def _with_tight(df: DataFrame, name: str) -> DataFrame:
    """With ``_tight``, whether the tight leptons are those of a last selection of the channel, and the pairs it needs."""
    if name == "DL":
        # a pair needs two: with fewer its columns are NULL, which fails the selections as no pair does
        two = F.size("tight_electrons") + F.size("tight_muons") >= 2
        df = df.withColumns({f"_{c}": F.when(two, F.col(c)) for c in ("tight_electrons", "tight_muons")})
        df = selection.mixed_by_pt(selection.lepton_pairs(df, "_tight_electrons", "_tight_muons"))
        df = df.drop("_tight_electrons", "_tight_muons")
    return df.withColumn("_tight", selection.dl_tight() if name == "DL" else selection.sl_tight())


def _nested(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ArrayType | StructType)]


def candidates(names: Sequence[str], cuts: Cuts = DEFAULT) -> list[tuple[dict[str, coll.Predicate], int]]:
    """What the stored leptons of every event that :func:`promising` keeps fulfil by their own fields.

    For each channel conditions by collection and the least number of leptons that fulfil theirs; an event keeps to one of
    the channels.
    """

    def above(muon: float, electron: float) -> dict[str, coll.Predicate]:
        return {
            "Muon": lambda x: objects.muon_candidate(x, muon, cuts.leptons),
            "Electron": lambda x: objects.electron_candidate(x, electron, cuts.leptons),
        }

    of_channel = {
        "DL": (above(selection.PAIR_EACH, selection.PAIR_EACH), 2),
        "SL": (above(selection.ONE_MUON, selection.ONE_ELECTRON), 1),
    }
    return [of_channel[name] for name in names]


def promising(
    df: DataFrame,
    names: Sequence[str],
    cuts: Cuts = DEFAULT,
    stored: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The events whose tight leptons are those of a last selection of one of the channels, stored once with their leptons.

    :func:`channel` with ``last`` takes them for the events: each channel, and each of its results, then reads these few
    instead of building all events again. Plots of all events (flag of the base selection) need all events. ``stored`` may add
    collections to the events that are kept. ``df`` may leave out events without enough :func:`candidates`.
    """
    found = objects.electrons(objects.muons(df, cuts.leptons), cuts.leptons)
    columns = found.columns
    for name in names:
        found = _with_tight(found, name).withColumnRenamed("_tight", f"_tight_{name}")
    tight = ops.any_of(*[F.col(f"_tight_{name}") for name in names])
    found = found.select(*columns, tight.alias("_tight"))
    # a generator, since a filter would be pushed below the collections and build them a second time
    kept = found.select(*columns, F.explode(F.when(F.col("_tight"), F.array(F.lit(True)))).alias("_tight"))
    kept = kept.drop("_tight")
    return pinned(kept if stored is None else stored(kept))
