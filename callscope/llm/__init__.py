"""Operators for preparing training data: each module holds one operator with a
general DataFrame interface; ``queries`` registers the thin ``opN_*`` queries."""
