"""Month arithmetic and job parameters.

All month arithmetic on parameters happens in Python when the plan is built, so the plan only ever
sees literals and Spark can use them for partition pruning and filter pushdown.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from decimal import ROUND_CEILING, Decimal


@dataclass(frozen=True, order=True)
class Month:
    """A month written YYYYMM, as used for registry snapshots and payroll months."""

    yyyymm: int

    def __post_init__(self) -> None:
        if not 1 <= self.yyyymm % 100 <= 12 or not 1 <= self.yyyymm // 100 <= 9999:
            raise ValueError(f"not a YYYYMM month: {self.yyyymm}")

    @property
    def absolute(self) -> int:
        """Months counted as YEAR*12 + MONTH."""
        return self.yyyymm // 100 * 12 + self.yyyymm % 100

    def plus(self, months: int) -> Month:
        year, month0 = divmod(self.absolute - 1 + months, 12)
        return Month(year * 100 + month0 + 1)

    @property
    def first_day(self) -> date:
        return date(self.yyyymm // 100, self.yyyymm % 100, 1)

    @property
    def last_day(self) -> date:
        return self.plus(1).first_day - timedelta(days=1)


@dataclass(frozen=True)
class Period:
    """The one snapshot month that drives a job, with the payroll and queue months derived from it.

    The payroll usually runs one month after the snapshot; the queue month is the snapshot month in most
    jobs and one month later in two of them (the stratified sample and the count of queued families).
    ``as_of`` is the day ages are measured at; ``None`` means the current date when the query runs.
    """

    anomes_ods: int
    payroll_offset: int = 1
    queue_offset: int = 0
    as_of: date | None = None

    @property
    def month(self) -> Month:
        return Month(self.anomes_ods)

    @property
    def rf_payroll(self) -> int:
        return self.month.plus(self.payroll_offset).yyyymm

    @property
    def rf_queue(self) -> int:
        return self.month.plus(self.queue_offset).yyyymm


@dataclass(frozen=True)
class Territory:
    """A state (two-digit code) and optionally one municipality in it (five-digit code)."""

    uf: int
    municipality: int | None = None

    @classmethod
    def from_codibge(cls, codibge: str) -> Territory:
        if len(codibge) != 7 or not codibge.isdigit():
            raise ValueError(f"a municipality code has 7 digits: {codibge!r}")
        return cls(int(codibge[:2]), int(codibge[2:]))

    @property
    def codibge(self) -> str:
        if self.municipality is None:
            raise ValueError("a whole state has no 7-digit code")
        return f"{self.uf:02d}{self.municipality:05d}"


@dataclass(frozen=True)
class CandidateRules:
    """Filters of the candidate extractions. ``None`` switches a filter off."""

    age: tuple[int, int] | None = None
    months_since_update: tuple[int | None, int] | None = None
    schooling: tuple[str, ...] | None = None


@dataclass(frozen=True)
class SamplePlan:
    """Size and shares of a stratified sample.

    Quotas are rounded up one by one, so they may add up to more than ``total`` (250 at 40/35/25 gives
    100 + 88 + 63 = 251). With ``cap=True`` the surplus is taken off the fill stratum's quota. Another
    ``seed`` draws other persons.
    """

    total: int
    shares: dict[str, Decimal] = field(
        default_factory=lambda: {"CAD": Decimal("0.40"), "PRE": Decimal("0.35"), "PBF": Decimal("0.25")}
    )
    fill: str = "CAD"
    cap: bool = False
    seed: int | None = None

    @classmethod
    def for_vacancies(cls, vacancies: int, **options) -> SamplePlan:
        """Twenty candidates for each vacancy, at least 250."""
        return cls(total=max(250, 20 * vacancies), **options)

    def quotas(self) -> dict[str, int]:
        quota = {
            name: int((self.total * Decimal(str(share))).to_integral_value(ROUND_CEILING))
            for name, share in self.shares.items()
        }
        if self.cap:
            surplus = max(0, sum(quota.values()) - self.total)
            quota[self.fill] = max(0, quota[self.fill] - surplus)
        return quota
