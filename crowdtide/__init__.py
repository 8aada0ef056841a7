"""Audience-reaction analytics on Spark DataFrames.

Every public function takes DataFrames keyed by ``(session_id, channel_id)`` and
returns a DataFrame; nothing here collects to the driver.
"""
