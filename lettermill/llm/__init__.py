"""Operators for preparing text for language-model training.

Nothing outside this package imports it.  Every operator is a function from
DataFrame to DataFrame; the heavy step runs in ``mapInArrow`` over Arrow
batches, so a task holds one batch at a time and no key is ever gathered in one
place.
"""
