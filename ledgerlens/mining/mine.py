"""Mining one view end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.mining import cube as cubes
from ledgerlens.mining import siblings
from ledgerlens.mining.config import ViewConfig
from ledgerlens.mining.patterns import scope_patterns
from ledgerlens.session import cut_lineage


def finding_id(depth: int):
    """Identity of a finding from what defines its sibling set."""
    parts = ["view", "strategy", "extending_dimension", "pattern_type", "breakdown", "measure"]
    parts += [f"filter{i}_{p}" for i in range(1, depth + 1) for p in ("dim", "value")]
    return F.concat_ws("~", *[F.coalesce(F.col(p), F.lit("")) for p in parts])


@dataclass
class Mining:
    """Stages of one mining run, each written once when first asked for."""

    view: DataFrame
    config: ViewConfig

    @cached_property
    def cube(self) -> cubes.Cube:
        return cubes.build_cube(self.view, self.config)

    @cached_property
    def points(self) -> DataFrame:
        return cut_lineage(cubes.points(self.cube), "points")

    @cached_property
    def shares(self) -> DataFrame:
        return cut_lineage(cubes.slice_shares(self.cube), "shares")

    @cached_property
    def scopes(self) -> DataFrame:
        layout = self.cube.layout
        order = "code" if layout.ordered_codes else "label"
        found = scope_patterns(self.points, layout.keys, self.config, order)
        return cut_lineage(siblings.with_seed_and_support(self.cube, found, self.shares), "scopes")

    @cached_property
    def members(self) -> DataFrame:
        return siblings.memberships(self.cube, self.scopes)

    @cached_property
    def all_findings(self) -> DataFrame:
        out = siblings.findings(self.cube, self.scopes, self.members, self.shares)
        return cut_lineage(out.withColumn("finding_id", finding_id(self.config.max_subspace_depth)), "findings")

    @property
    def findings(self) -> DataFrame:
        return self.all_findings.filter(~F.col("low_support"))

    @property
    def displaced(self) -> DataFrame:
        """Findings whose common pattern rests on series without enough non-zero points."""
        return self.all_findings.filter("low_support")

    @cached_property
    def finding_members(self) -> DataFrame:
        """Every sibling of every finding, for listings."""
        return siblings.finding_members(self.cube, self.findings, self.members)

    @cached_property
    def own_members(self) -> DataFrame:
        """Siblings that hold a finding's own pattern."""
        return siblings.own_members(self.cube, self.findings, self.members)

    @cached_property
    def own_digests(self) -> DataFrame:
        """Which siblings hold each finding's own pattern, as digests; what merging and comparing findings needs."""
        return cut_lineage(siblings.own_digests(self.cube, self.findings, self.members), "own-digests")

    @cached_property
    def member_digests(self) -> DataFrame:
        """What each finding's siblings are, as digests."""
        return cut_lineage(siblings.member_digests(self.cube, self.findings, self.members), "member-digests")

    def named_members(self, labels: list[str]) -> DataFrame:
        """The siblings of findings that have one of a few labels."""
        return siblings.set_members(self.cube, self.findings, labels)


def top_store(found: DataFrame, k: int) -> DataFrame:
    """The k best findings; at the cut a score tie keeps the larger identity."""
    return found.dropDuplicates(["finding_id"]).orderBy(F.desc("score"), F.desc("finding_id")).limit(k)
