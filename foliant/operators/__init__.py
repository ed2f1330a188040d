"""Operators on whole tables: profiles, sinks of rows as text, and the books of jobs, shares and quotas."""
