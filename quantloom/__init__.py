"""quantloom: equity and listed-option analytics as lazy Spark DataFrame transforms.

Every operator takes DataFrames and returns a DataFrame; nothing collects,
nothing reads the clock, and every "latest", "today" or "now" is a parameter.
"""
