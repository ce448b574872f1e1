"""Parameters shared by the analytics (club, seasons, scope rules)."""

from __future__ import annotations

from dataclasses import dataclass

from .. import constants as K


@dataclass(frozen=True)
class Params:
    club: int = K.DEFAULT_CLUB
    seasons: tuple = K.DEFAULT_SEASONS
    competitions: tuple = K.DEFAULT_COMPETITIONS
    date_from: str = K.DEFAULT_DATE_FROM
    # upper end of the match date range; None means today (the original's CURRENT_DATE)
    as_of: str | None = None
    # shots come from one competition, one extract per season; the last season's
    # extract also carries the shot type from the secondary-type table
    shot_competition: int = K.DEFAULT_SHOT_COMPETITION
    shot_seasons: tuple = (189918, 191611)
    # the original's club pass set has no type filter (None); a tuple keeps only those types
    club_pass_types: tuple | None = None
    # "global" = lead over the whole ordered log (original), "match" = within a match
    sequence_scope: str = "global"
    # every common row of an event gives its minute (original); True takes one row per event
    dedup_minutes: bool = False
    # every tag row of an event gives an assist row (original); True counts a pass once
    dedup_assists: bool = False
    # every result row of a (match, team) counts (original); True takes the first one
    dedup_scores: bool = False
    # every row of the player table gives a line (original); True takes one row per player
    dedup_players: bool = False
    min_bin_shots: int = 1
    top_n: int = 10
    match_id: int | None = None

    def __post_init__(self) -> None:
        # parameters key the shared derived tables, so list arguments become tuples
        for name in ("seasons", "competitions", "shot_seasons", "club_pass_types"):
            value = getattr(self, name)
            if isinstance(value, (list, set)):
                object.__setattr__(self, name, tuple(value))
