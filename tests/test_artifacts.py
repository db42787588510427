import numpy as np
import pytest

from psephos import artifacts, dims

RACE = dims.BLOCS["race"]


def test_weights():
    artifacts.check_weights(dict.fromkeys(RACE, 0.2))
    for bad in (dict.fromkeys(RACE, 0.3), dict.fromkeys(RACE[:4], 0.25), dict.fromkeys(RACE, 0.2) | {"white": -0.2}, dict.fromkeys(RACE, float("nan"))):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.check_weights(bad)


def test_covariance():
    artifacts.check_covariance(np.eye(5))
    for bad in (np.eye(4), np.triu(np.ones((5, 5))), np.full((5, 5), np.nan)):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.check_covariance(bad)


def test_simulation_bins_target():
    artifacts.check_simulation(0.5, 0.4, 0.6, {"a": [1, 2, 3, 4, 5]})
    artifacts.check_bins(dict.fromkeys(RACE, "neutral"), RACE)
    artifacts.check_target(0.4934)
    for call in (lambda: artifacts.check_simulation(0.9, 0.4, 0.6, {}), lambda: artifacts.check_simulation(0.5, 0.4, 0.6, {"a": [2, 1, 3, 4, 5]}), lambda: artifacts.check_bins(dict.fromkeys(RACE, "big"), RACE), lambda: artifacts.check_target(0.9)):
        with pytest.raises(artifacts.ArtifactError):
            call()
