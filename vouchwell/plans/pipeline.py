"""The whole verification run: profiles, roles and recorded responses in, briefs and drops out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from vouchwell.operators import brief, claims, fit


class Verified:
    """Arcs with their kept claims, every dropped claim with its reason, and the profiles whose
    response couldn't be used. Each result is composed when it is asked for, and runs when it is
    written or counted."""

    def __init__(self, profiles: DataFrame, responses: DataFrame, whole_words: bool = False):
        self._profiles, self._responses, self._whole_words = profiles, responses, whole_words

    @cached_property
    def _read(self) -> DataFrame:
        return claims.read_responses(self._profiles, self._responses)

    @cached_property
    def _tested(self) -> DataFrame:
        return claims.gated(self._read, self._whole_words)

    @cached_property
    def arcs(self) -> DataFrame:
        return claims.arcs(self._tested)

    @cached_property
    def kept(self) -> DataFrame:
        return claims.kept_claims(self._tested)

    @cached_property
    def drops(self) -> DataFrame:
        return claims.dropped_claims(self._tested)

    @cached_property
    def failures(self) -> DataFrame:
        return claims.read_failures(self._profiles, self._responses)


class Run(Verified):
    """``Verified``, and for each pair with a recorded fit response the verdict and the brief."""

    def __init__(self, profiles, responses, roles: DataFrame, fit_responses: DataFrame, whole_words: bool = False):
        super().__init__(profiles, responses, whole_words)
        self._roles, self._fit_responses = roles, fit_responses

    @cached_property
    def judged(self) -> DataFrame:
        """Every pair, with the failure of its response or else its fit: one pass over the arcs for both."""
        return fit.judge(self.arcs, self._roles, self._profiles, self._fit_responses, carry=brief.SAYS)

    @cached_property
    def _assessed(self) -> tuple[DataFrame, DataFrame]:
        return fit.parted(self.judged)

    @cached_property
    def fits(self) -> DataFrame:
        return self._assessed[0].drop(*brief.SAYS)

    @cached_property
    def fit_failures(self) -> DataFrame:
        return self._assessed[1]

    @cached_property
    def briefs(self) -> DataFrame:
        return brief.briefs_of(self._assessed[0])  # from the same rows: arcs are computed once


def verify(profiles: DataFrame, responses: DataFrame, whole_words: bool = False) -> Verified:
    return Verified(profiles, responses, whole_words)


def run(profiles: DataFrame, responses: DataFrame, roles: DataFrame, fit_responses: DataFrame, whole_words: bool = False) -> Run:
    return Run(profiles, responses, roles, fit_responses, whole_words)
