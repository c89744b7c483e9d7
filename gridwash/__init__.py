"""gridwash: table cleanup as Spark DataFrame operators, recorded as steps and replayed as recipes."""

from gridwash.plans.recipes import Recipe, apply_recipe
from gridwash.plans.steps import Step, replay
from gridwash.session import build_session, configure

__all__ = ["Recipe", "Step", "apply_recipe", "build_session", "configure", "replay"]
