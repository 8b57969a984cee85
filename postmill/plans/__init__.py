"""Queries by subject."""


def all_registries() -> list:
    from postmill.plans import pages, runs, scores, stars, states, texts, training

    return [pages.R, runs.R, scores.R, stars.R, states.R, texts.R, training.R]
