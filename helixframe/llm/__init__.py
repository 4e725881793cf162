"""Training-data operators: ten corpus-scale steps, each in its own module.

Nothing else in the package imports this subpackage; the driver entry adds its
queries only when it can be imported.
"""
