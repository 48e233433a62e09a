"""The questions a fleet operator asks, with their usual defaults, over stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fleetlake.operators import fleet, presentation
from fleetlake.operators.filters import QueryWindow
from fleetlake.operators.ordered import AUTO, Slices
from fleetlake.plans import device
from fleetlake.plans.fleet import fleet_report


@dataclass(frozen=True)
class Lake:
    """Tables and the instant questions refer to.

    Device questions look at ``hours`` before ``as_of`` or an explicit range (``params``) and at all events in it; a ``limit`` in the
    parameters, where one is given, takes that many events of each device. The timeline alone has a limit of its own (100).
    Fleet questions look at all states; their ``limit`` is one on the answer. Without ``device_id`` all devices are answered for.
    """

    as_of: str
    index: DataFrame
    states: DataFrame | None = None
    archive: DataFrame | None = None
    inventory: DataFrame | None = None
    snapshots: DataFrame | None = None
    configuration: DataFrame | None = None
    slices: Slices | str | None = AUTO

    def _window(self, params: dict[str, str] | None, hours: float, most: float, limit: int) -> QueryWindow:
        return QueryWindow.parse(params or {}, self.as_of, hours, most, limit, 1000)

    def timeline(self, params: dict[str, str] | None = None, device_id: str | None = None) -> DataFrame:
        """Newest events first."""
        rows = device.timeline(self.index, self._window(params, 24, 168, 100), device_id)
        return rows.orderBy("device_id", F.col("event_time").desc())

    def health(self, params: dict[str, str] | None = None, device_id: str | None = None) -> DataFrame:
        return device.health(self.index, self._window(params, 24, 168, 1000), device_id, "limit" in (params or {}), digits=2)

    def anomalies(self, params: dict[str, str] | None = None, device_id: str | None = None) -> DataFrame:
        return device.anomalies(self.index, self._window(params, 24, 168, 1000), device_id, "limit" in (params or {}), self.slices)

    def summary(self, params: dict[str, str] | None = None, device_id: str | None = None) -> DataFrame:
        return device.summary(self.index, self._window(params, 168, 720, 1000), device_id, "limit" in (params or {}), self.slices)

    def type_counts(self, params: dict[str, str] | None = None, device_id: str | None = None) -> DataFrame:
        return device.type_counts(device.in_window(self.index, self._window(params, 168, 720, 1000), device_id, False, "limit" in (params or {})))

    def serial(self, window: QueryWindow, device_id: str | None = None, include_collector: bool = False, contains: str | None = None) -> DataFrame:
        """Serial lines of the newest events of a window, oldest first."""
        rows = device.in_window(self.index.drop("data"), window, device_id, True, True)
        return presentation.serial_log(rows, include_collector, contains, window.limit).orderBy("device_id", "event_time", "event_id")

    def _project(self, project: str | None) -> DataFrame:
        return self.states if project is None else self.states.filter(F.col("project_id") == project)

    def fleet_summary(self, project: str | None = None, hours: float = 24, status: str | None = None) -> DataFrame:
        return fleet.counters(self._project(project), self.as_of, hours, status)

    def fleet_anomalies(self, project: str | None = None, hours: float = 24, status: str | None = None, limit: int | None = None) -> DataFrame:
        return fleet.at_risk(self._project(project), self.as_of, hours, status, limit)

    def fleet_offline(self, project: str | None = None, threshold_hours: float = 3, limit: int | None = None) -> DataFrame:
        return fleet.offline_devices(self._project(project), self.as_of, threshold_hours, limit)

    def timeline_analytics(self, gap_minutes: float = 90, burst_minutes: float = 10) -> DataFrame:
        return device.timeline_analytics(self.index, gap_minutes, burst_minutes, self.slices)

    def payload_health(self) -> DataFrame:
        return device.payload_health(self.index, self.archive, self.slices)

    def correlation(self, minutes: float = 5):
        """Members, windows and inferences."""
        return device.correlation(self.index, self.archive, minutes, self.slices)

    def report(self, product_id: str, allowance: float = fleet.TRANSPORT_ALLOWANCE_SECONDS) -> dict[str, DataFrame]:
        return fleet_report(self.inventory, self.states, self.snapshots, self.configuration, product_id, self.as_of, allowance)
