"""The best of many scores for each of a few questions, held while blocks of scores go by."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``limit`` highest scores of each question, ties to the smaller id; memory is that of what is held."""

    def __init__(self, questions: int, limit: int) -> None:
        self.limit = limit
        self.least = np.full(questions, -np.inf)  # a score below is not among the best
        self.question, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """scores: rows are the ids, columns the questions from ``first`` on; -inf takes no part."""
        if len(ids) > self.limit:
            edge = np.partition(scores, len(ids) - self.limit, axis=0)[len(ids) - self.limit]
        else:
            edge = np.full(scores.shape[1], -np.inf)
        edge = np.maximum(edge, self.least[first : first + scores.shape[1]])
        row, column = np.nonzero((scores >= edge) & (scores > -np.inf))
        if not len(row):
            return
        question = np.concatenate([self.question, column + first])
        score, at = np.concatenate([self.score, scores[row, column]]), np.concatenate([self.id, ids[row]])
        order = np.lexsort((at, -score, question))
        question, score, at = question[order], score[order], at[order]
        starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        place = np.arange(len(question)) - np.repeat(starts, np.diff(np.r_[starts, len(question)]))
        kept = place < self.limit
        self.least[question[place == self.limit - 1]] = score[place == self.limit - 1]
        self.question, self.score, self.id = question[kept], score[kept], at[kept]
