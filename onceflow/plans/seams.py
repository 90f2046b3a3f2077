"""Named places at which a test may kill the driver, to see what a crash leaves behind. Off unless two environment variables say otherwise."""

from __future__ import annotations

import os

#: In the order in which a batch comes by them; takeover only where a lease was taken over.
SEAMS = ("after_claim", "during_reconcile_takeover", "after_mark_executing", "after_dispatch", "after_record")


def seam(name: str) -> None:
    """Ends the process at once, with nothing cleaned up, if ONCEFLOW_TESTING is 1 and ONCEFLOW_CRASH_AT names this place."""
    if os.environ.get("ONCEFLOW_TESTING") == "1" and os.environ.get("ONCEFLOW_CRASH_AT") == name:
        os._exit(137)
