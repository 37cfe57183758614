"""The phrase state machine over a run of blocks, without a loop over blocks.

Rule: while idle, a phrase starts at a block whose last ``window`` blocks hold
``required`` voiced ones, all of them after the last clear; it then contains
the pre-roll. It ends after ``end_silence`` trailing silent blocks or at
``max_blocks``. Starting and ending clear the votes, ending also the pre-roll.

States are numbered: 0..n-1 is idle with that many blocks since the last
clear (more do not matter), above that recording with (length, silent).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SegmentRules:
    """Segmentation constants in blocks of ``block_s`` seconds (fixed defaults)."""

    block_s: float = 0.1
    window: int = 4
    required: int = 3
    pre_roll: int = 12
    end_silence: int = 12
    max_blocks: int = 200
    min_blocks: int = 5

    @property
    def idle_states(self) -> int:
        return max(self.pre_roll, self.window) + 1

    @property
    def states(self) -> int:
        return self.idle_states + self.max_blocks * self.end_silence

    def recording(self, length: int, silent: int) -> int:
        return self.idle_states + length * self.end_silence + silent


class BlockRun:
    """Blocks ``first..`` of a device, preceded by ``first`` earlier ones."""

    def __init__(self, voiced: np.ndarray, first: int, rules: SegmentRules) -> None:
        self.rules, self.first, self.n = rules, first, len(voiced)
        at = np.arange(self.n)
        total = np.concatenate([[0], np.cumsum(voiced)])
        votes = total[at + 1] - total[np.maximum(at + 1 - rules.window, 0)]
        last_voiced = np.maximum.accumulate(np.where(voiced, at, -1)) if self.n else at
        self.trail = at - last_voiced
        self.onsets = np.flatnonzero(votes >= rules.required)
        self.quiet = np.flatnonzero(self.trail >= rules.end_silence)
        later = np.flatnonzero(voiced[first:])
        self.first_voiced = first + int(later[0]) if len(later) else self.n
        self._exit: dict[int, int] = {}

    @staticmethod
    def _next(positions: np.ndarray, low: int, default: int) -> int:
        k = int(np.searchsorted(positions, low))
        return int(positions[k]) if k < len(positions) else default

    def _phrase(self, cleared: int):
        """(start, end, length, reason) of the next phrase after a clear, or its open state."""
        r, beyond = self.rules, self.n + self.rules.max_blocks
        start = self._next(self.onsets, max(cleared + r.window, self.first), beyond)
        if start >= self.n:
            return None, min(self.n - 1 - cleared, r.idle_states - 1)
        head = min(start - cleared, r.pre_roll)
        silent_end = self._next(self.quiet, start + r.end_silence - 1, beyond)
        full_end = start + r.max_blocks - head
        end = min(silent_end, full_end)
        if end >= self.n:
            length = head + self.n - 1 - start
            return None, r.recording(length, min(int(self.trail[-1]), self.n - start))
        reason = "vad_end" if silent_end <= full_end else "max_duration"
        return (end, head + end - start, reason), end

    def _entry(self, state: int):
        """First event from an entry state: a clear position, or an exit state."""
        r = self.rules
        if state < r.idle_states:
            return None, self.first - 1 - state, None
        length, silent = divmod(state - r.idle_states, r.end_silence)
        run_out = self.first + r.end_silence - silent - 1
        if run_out >= self.first_voiced:
            run_out = self._next(self.quiet, self.first_voiced, self.n + r.max_blocks)
        full = self.first - 1 + r.max_blocks - length
        end = min(run_out, full)
        if end >= self.n:
            done = self.n - self.first
            now_silent = int(self.trail[-1]) if self.first_voiced < self.n else silent + done
            return None, None, r.recording(length + done, now_silent)
        reason = "vad_end" if run_out <= full else "max_duration"
        return (end, length + end - (self.first - 1), reason), end, None

    def run(self, state: int):
        """All phrases that end here as (end, length, reason), and the exit state."""
        phrases = []
        ended, cleared, exit_state = self._entry(state)
        if ended:
            phrases.append(ended)
        while exit_state is None:
            ended, at = self._phrase(cleared)
            if ended is None:
                exit_state = at
            else:
                phrases.append(ended)
                cleared = at
        return phrases, exit_state

    def _exit_after(self, cleared: int) -> int:
        """Exit state after a clear; runs that meet share their continuation."""
        path = []
        while cleared not in self._exit:
            ended, at = self._phrase(cleared)
            path.append(cleared)
            if ended is None:
                for p in path:
                    self._exit[p] = at
                return at
            cleared = at
        for p in path:
            self._exit[p] = self._exit[cleared]
        return self._exit[cleared]

    def exits(self) -> np.ndarray:
        """Exit state for every entry state; one element if all agree."""
        out = np.empty(self.rules.states, dtype=np.int32)
        for state in range(self.rules.states):
            _, cleared, exit_state = self._entry(state)
            out[state] = self._exit_after(cleared) if exit_state is None else exit_state
        return out[:1] if (out == out[0]).all() else out


@dataclass(frozen=True)
class CaptureRules:
    """An armed capture's constants in blocks (fixed defaults)."""

    window: int = 3
    required: int = 3
    pre_roll: int = 3
    start_timeout: int = 80
    end_silence: int = 12
    max_blocks: int = 200
    min_blocks: int = 0
    post_roll: int = 2

    @property
    def reach(self) -> int:
        return self.start_timeout + self.max_blocks


def capture_end(at: np.ndarray, voiced: np.ndarray, rules: CaptureRules, complete: bool):
    """(reason, onset, stop, kept blocks) of one armed session.

    ``at`` are the block numbers seen, ascending. While more may come, only
    what gapless blocks from the first on decide is certain; None means that
    nothing is yet. ``complete`` closes a session without an end as OPEN.
    """
    if not complete:
        gapless = int(np.argmin(np.append(at, -1) == np.arange(len(at) + 1)))
        at, voiced = at[:gapless], voiced[:gapless]
    if not len(at):
        return ("OPEN", None, None, None) if complete else None
    votes = np.convolve(voiced.astype(int), np.ones(rules.window, int))[:len(at)]
    full = np.arange(len(at)) >= rules.window - 1
    starts = np.flatnonzero(full & (votes >= rules.required) & (at < rules.start_timeout))
    if not len(starts):
        if len(at) and at[-1] + 1 >= rules.start_timeout:
            return "NO_SPEECH", None, rules.start_timeout - 1, None
        return ("OPEN", None, None, None) if complete else None
    first = int(starts[0])
    onset = int(at[first])
    i, heard = at[first:], voiced[first:]
    silent = i - np.maximum.accumulate(np.where(heard, i, onset))
    n = i - onset + min(onset + 1, rules.pre_roll)
    later = i > onset
    for by, reason in ((silent >= rules.end_silence) & (n >= rules.min_blocks), "END_SILENCE"), (n >= rules.max_blocks, "MAX_DURATION"):
        hit = np.flatnonzero(by & later)
        other = np.flatnonzero((n >= rules.max_blocks) & later)
        if len(hit) and (reason == "MAX_DURATION" or not len(other) or hit[0] <= other[0]):
            k = int(hit[0])
            return reason, onset, int(i[k]), int(n[k] - max(silent[k] - rules.post_roll, 0))
    return ("OPEN", onset, None, None) if complete else None
