from shelfcast.plans.catalog import ORACLES
from shelfcast.plans.q_forecast import H
from shelfcast.plans.q_planted import FOLDS_2


def test_tuning_ranks_all_steps():
    assert f"count(*) * {H * len(FOLDS_2)} AS n" in ORACLES["planted_tune"]
