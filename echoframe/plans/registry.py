"""Imports every plan module so that its queries are registered."""

from echoframe.plans import (  # noqa: F401
    label_plans,
    policy_plans,
    position_plans,
    roundtrip_plans,
    sampling_plans,
    vector_plans,
)
from echoframe.plans.catalog import ORACLES, PLANS  # noqa: F401
