"""Operations of a training-data pipeline over document tables.

Every operator takes DataFrames and returns a DataFrame. ``lakeops.llm.checks`` registers one query per
operator; nothing else in the library imports this subpackage.
"""
