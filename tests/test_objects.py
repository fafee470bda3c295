import pytest
from builders import NAN, column, electron, events, fat_jet, jet, muon, sub_jet, tau
from pyspark.sql import functions as F

from eventspark.operators import objects


def count(spark, name, channel, *rows):
    return column(objects.define_objects(events(spark, *rows), channel), F.size(name))


def test_muon_cut_edges(spark):
    cases = [
        (dict(pt=5.0), 1), (dict(pt=4.99), 0), (dict(eta=2.4), 1), (dict(eta=-2.41), 0), (dict(dxy=-0.05), 1),
        (dict(dxy=0.051), 0), (dict(dz=0.1), 1), (dict(dz=0.11), 0), (dict(miniPFRelIso_all=0.4), 1),
        (dict(miniPFRelIso_all=0.41), 0), (dict(sip3d=8.0), 1), (dict(sip3d=8.1), 0), (dict(looseId=False), 0),
        (dict(pt=NAN), 0),
    ]
    assert count(spark, "muons", "DL", *[[muon(**c)] for c, _ in cases]) == [n for _, n in cases]


def test_electron_cut_edges(spark):
    cases = [
        (dict(pt=7.0), 1), (dict(pt=6.9), 0), (dict(eta=2.5), 1), (dict(eta=2.51), 0), (dict(lostHits=1), 1),
        (dict(lostHits=2), 0), (dict(sip3d=8.01), 0),
    ]
    assert count(spark, "electrons", "DL", *[[electron(**c)] for c, _ in cases]) == [n for _, n in cases]


def test_conept_and_sorting(spark):
    rows = [[
        muon(pt=20.0, mvaTTH=0.6),                        # medium and high score: plain pt
        muon(pt=40.0, mvaTTH=0.5, jetRelIso=0.0),         # score not above 0.50: 0.9 * 40
        muon(pt=40.0, mediumId=False, jetRelIso=0.5),     # 0.9 * 40 * 1.5
        muon(pt=10.0, pdgId=15),                          # other particle: plain pt
    ]]
    df = objects.define_objects(events(spark, *rows), "DL")
    assert column(df, F.col("muons")["idx"]) == [[2, 1, 0, 3]]
    assert column(df, F.col("muons")["conept"])[0] == pytest.approx([54.0, 36.0, 20.0, 10.0])


def test_tight_muons(spark):
    cases = [
        ([muon(pt=10.0)], 1), ([muon(pt=9.9)], 0), ([muon(mvaTTH=0.5, pt=20.0)], 1), ([muon(mvaTTH=0.49)], 0),
        ([muon(mediumId=False)], 0), ([muon(jetIdx=0), jet(btagDeepFlavB=0.277)], 1),
        ([muon(jetIdx=0), jet(btagDeepFlavB=0.278)], 0), ([muon(jetIdx=5), jet(btagDeepFlavB=0.9)], 1),
    ]
    assert count(spark, "tight_muons", "DL", *[r for r, _ in cases]) == [n for _, n in cases]


def test_fakeable_muon_ramp(spark):
    # soft pt 20 -> limit 0.2770, 45 -> 0.0494; a b-tag above medium never passes below the ramp's start
    low, high = dict(pt=20 / 0.9, jetIdx=0, mvaTTH=0.1), dict(pt=60.0, jetIdx=0, mvaTTH=0.1)
    cases = [
        ([muon(**low), jet(btagDeepFlavB=0.277)], 1),
        ([muon(**low), jet(btagDeepFlavB=0.28)], 0),
        ([muon(**high), jet(btagDeepFlavB=0.2)], 1),  # passes the medium limit although above the ramp's value
        ([muon(**{**low, "jetRelIso": 0.9}), jet(btagDeepFlavB=0.28)], 0),
    ]
    assert count(spark, "fake_muons", "DL", *[r for r, _ in cases]) == [n for _, n in cases]


def test_electron_quality(spark):
    cases = [
        (dict(sieie=0.011), 1), (dict(sieie=0.012), 0), (dict(eta=1.5, sieie=0.030), 1), (dict(eta=1.5, sieie=0.031), 0),
        (dict(eta=1.4, deltaEtaSC=0.2, sieie=0.02), 1), (dict(hoe=0.10), 1), (dict(hoe=0.11), 0),
        (dict(eInvMinusPInv=-0.04), 1), (dict(eInvMinusPInv=-0.05), 0), (dict(convVeto=False), 0), (dict(lostHits=1), 0),
        (dict(mvaTTH=0.30), 1), (dict(mvaTTH=0.29), 0),
    ]
    assert count(spark, "tight_electrons", "DL", *[[electron(**c)] for c, _ in cases]) == [n for _, n in cases]


def test_fakeable_electron_uses_tighter_btag_for_low_score(spark):
    low = dict(mvaTTH=0.1, jetRelIso=0.5, jetIdx=0)
    cases = [
        ([electron(**low), jet(btagDeepFlavB=0.7)], 1),   # low score: tight limit 0.7264
        ([electron(**low), jet(btagDeepFlavB=0.73)], 0),
        ([electron(jetIdx=0), jet(btagDeepFlavB=0.5)], 0),  # high score: medium limit
        ([electron(**{**low, "jetRelIso": 0.7})], 0),
        ([electron(**{**low, "mvaNoIso_WP90": False})], 0),
    ]
    assert count(spark, "fake_electrons", "DL", *[r for r, _ in cases]) == [n for _, n in cases]


def test_electron_cleaning_edge(spark):
    rows = [[electron(eta=0.3), muon()], [electron(eta=0.31), muon()], [electron(eta=0.3), muon(looseId=False)]]
    assert count(spark, "clean_electrons", "DL", *rows) == [0, 1, 1]


def test_taus(spark):
    cases = [
        ([tau()], 1), ([tau(pt=20.0)], 0), ([tau(eta=2.3)], 0), ([tau(dz=0.2)], 1), ([tau(decayMode=5)], 0),
        ([tau(decayMode=11)], 1), ([tau(idDeepTau2017v2p1VSjet=15)], 0), ([tau(idDeepTau2017v2p1VSjet=16)], 1),
        ([tau(idDeepTau2017v2p1VSe=2)], 0), ([tau(idDecayModeOldDMs=False)], 0), ([tau(eta=0.3), electron()], 0),
        ([tau(eta=0.31), muon()], 1),
    ]
    assert count(spark, "taus", "SL", *[r for r, _ in cases]) == [n for _, n in cases]


def test_jet_definition(spark):
    cases = [(dict(pt=25.0), 1), (dict(pt=24.9), 0), (dict(jetId=4), 0), (dict(jetId=2), 1), (dict(eta=-2.41), 0)]
    assert count(spark, "ak4_jets", "DL", *[[jet(**c)] for c, _ in cases]) == [n for _, n in cases]
    rows = [[jet(btagDeepFlavB=0.277)], [jet(btagDeepFlavB=0.2771)], [jet(btagDeepFlavB=NAN)]]
    assert count(spark, "ak4_bjets", "DL", *rows) == [0, 1, 0]


def test_jet_cleaning_two_leptons(spark):
    at = lambda eta: jet(eta=eta)
    rows = [
        [electron(), at(0.0)],                                            # one lepton: no cleaning at all
        [electron(), electron(eta=1.0), at(0.0), at(1.0), at(0.5)],       # both electrons clean
        [electron(), electron(eta=1.0), at(0.39), at(0.4), at(2.0)],      # below 0.4 goes, 0.4 stays
        [electron(), muon(eta=1.0), at(0.0), at(1.0), at(2.0)],
        # three leptons, the softest does not clean
        [electron(pt=50.0), electron(eta=1.0, pt=40.0), muon(eta=2.0, pt=30.0), at(0.0), at(1.0), at(2.0)],
        [electron(pt=50.0), electron(eta=1.0, pt=30.0), muon(eta=2.0, pt=40.0), at(0.0), at(1.0), at(2.0)],
        [muon(pt=50.0), muon(eta=1.0, pt=45.0), electron(eta=2.0, pt=40.0), at(0.0), at(1.0), at(2.0)],
        # ties: the muon leads, and the second place goes to the other flavour
        [electron(pt=40.0), electron(eta=1.0, pt=40.0), muon(eta=2.0, pt=40.0), at(0.0), at(1.0), at(2.0)],
        [electron(pt=40.0), muon(eta=1.0, pt=40.0), muon(eta=2.0, pt=40.0), at(0.0), at(1.0), at(2.0)],
        [at(0.0)],
    ]
    df = objects.define_objects(events(spark, *rows), "DL")
    assert column(df, F.col("ak4_jets")["idx"]) == [[0], [2], [1, 2], [2], [2], [1], [2], [1], [2], [0]]


def test_jet_cleaning_one_lepton(spark):
    at = lambda eta: jet(eta=eta)
    rows = [
        [electron(), at(0.0), at(1.0)],
        [muon(), at(0.0), at(1.0)],
        [electron(pt=40.0), muon(pt=40.0, eta=1.0), at(0.0), at(1.0)],  # tie: the electron leads
        [electron(pt=40.0), muon(pt=41.0, eta=1.0), at(0.0), at(1.0)],
        [at(0.0)],
    ]
    df = objects.define_objects(events(spark, *rows), "SL")
    assert column(df, F.col("ak4_jets")["idx"]) == [[1], [1], [1], [0], [0]]


def test_fat_jets(spark):
    subs = [sub_jet(), sub_jet()]
    cases = [
        ([fat_jet(), *subs], 1), ([fat_jet(pt=199.0), *subs], 0), ([fat_jet(msoftdrop=30.0), *subs], 1),
        ([fat_jet(msoftdrop=210.1), *subs], 0), ([fat_jet(tau1=0.0), *subs], 0),
        ([fat_jet(tau1=1.0, tau2=0.75), *subs], 1), ([fat_jet(tau1=1.0, tau2=0.76), *subs], 0),
        ([fat_jet(subJet2Idx=-1), *subs], 0), ([fat_jet(subJet2Idx=7), *subs], 0),
        ([fat_jet(), sub_jet(), sub_jet(pt=19.0)], 0), ([fat_jet(), sub_jet(eta=2.5), sub_jet()], 0),
    ]
    assert count(spark, "ak8_jets", "DL", *[r for r, _ in cases]) == [n for _, n in cases]


def test_fat_b_jets(spark):
    pair = lambda **c: [fat_jet(), sub_jet(btagDeepB=0.0), sub_jet(**c)]
    rows = [pair(), pair(btagDeepB=0.4184), pair(pt=30.0), pair(pt=29.0)]
    assert count(spark, "ak8_bjets", "DL", *rows) == [1, 0, 1, 0]


def test_fat_jet_order_depends_on_channel(spark):
    row = [fat_jet(pt=300.0, btagDeepB=0.1), fat_jet(pt=250.0, btagDeepB=0.9), sub_jet(), sub_jet()]
    for channel, expected in (("DL", [0, 1]), ("SL", [1, 0])):
        df = objects.define_objects(events(spark, row), channel)
        assert column(df, F.col("ak8_jets")["idx"]) == [expected]


def test_jets_away_from_fat_b_jet(spark):
    fat = [fat_jet(), sub_jet(), sub_jet()]
    rows = [[*fat, jet(eta=1.2)], [*fat, jet(eta=1.3)], [jet(eta=1.3)]]
    assert count(spark, "ak4_away", "SL", *rows) == [0, 1, 0]


def test_empty_event_has_empty_collections(spark):
    df = objects.define_objects(events(spark, []), "SL")
    for name in ("muons", "tight_electrons", "taus", "ak4_jets", "ak8_bjets", "ak4_away"):
        assert column(df, F.size(name)) == [0]


def test_unknown_channel(spark):
    with pytest.raises(ValueError):
        objects.define_objects(events(spark, []), "XX")
