def by_colour(rgb):
    """Reads the box at (20, 16) as t where the ground left of it is blue, as m where it is yellow."""
    r, _, b = rgb[14:30, 10:18].reshape(-1, 3).mean(axis=0)
    return [("t" if b > r else "m", 0.9, 20.0, 16.0, 16.0, 12.0), ("a", 0.6, 50.0, 2.0, 8.0, 8.0), ("t", 0.3, 20.0, 16.0, 16.0, 12.0)]
