def prose(seed, n, vocabulary=2000):
    """Deterministic words."""
    import random
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
