"""Registered queries: the operators applied to whole tables, each with SQL where SQL can say the same."""
