"""Selector syntax trees and the choice of an index."""
