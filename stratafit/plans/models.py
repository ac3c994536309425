"""The model types and their traits."""

from __future__ import annotations

from enum import StrEnum


class Model(StrEnum):
    LS = "ls"
    PR = "pr"
    LR = "lr"
    CLR = "clr"
    CLR_EFRON = "clr_efron"
    CLR_EXACT = "clr_exact"
    CPR = "cpr"
    SCCS = "sccs"
    COX = "cox"
    COX_RAW = "cox_raw"
    COX_TIME = "cox_time"
    FGR = "fgr"

    @property
    def survival(self) -> bool:
        """Its groups are risk sets in time."""
        return self in (Model.COX, Model.COX_RAW, Model.COX_TIME, Model.FGR)

    @property
    def stratified(self) -> bool:
        """Its groups are strata."""
        return self in (Model.CLR, Model.CLR_EFRON, Model.CLR_EXACT, Model.CPR, Model.SCCS)

    @property
    def intercept(self) -> bool:
        """It can have an intercept."""
        return not (self.survival or self.stratified)

    @property
    def own_time(self) -> bool:
        """It uses time itself, not as the offset ln(time)."""
        return self.survival or self is Model.SCCS

    @property
    def counts(self) -> bool:
        """Its outcomes are counts over a positive time."""
        return self in (Model.PR, Model.CPR)


#: Ids of the columns that no covariate has.
INTERCEPT_ID, OFFSET_ID = 0, -1
INTERCEPT_NAME = "(Intercept)"
