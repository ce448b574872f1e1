"""pitchframe: football match-event analytics as Spark DataFrame plans.

    from pitchframe import EventData, Params, ANALYTICS
    ANALYTICS["team_pass_success"](data, Params(club=7458))

``EventData`` holds the domain tables, ``Params`` the club / season / scope choices and
``ANALYTICS`` every named analytic (a function of ``(EventData, Params)``).
"""

from .plans.catalog import ANALYTICS
from .plans.params import Params
from .sources.tables import EventData

__all__ = ["ANALYTICS", "EventData", "Params"]
__version__ = "0.1.0"
