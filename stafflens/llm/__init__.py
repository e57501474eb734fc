"""Training-data operators: filters, near-duplicate removal, search, mixing and packing.

Each module holds one operator with a general interface; ``registry`` binds
them to the driver tables as queries. Nothing else in the library imports this
package.
"""
