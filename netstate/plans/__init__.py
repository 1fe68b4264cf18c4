"""Per-table getters and sheets, and the user-facing session object."""

from netstate.plans.api import NetState

__all__ = ["NetState"]
